"""Secret scans: fixed formats, and character Markov models of random strings and of ordinary identifiers.

DataFrame functions only. Both models are tables of character transitions, counted from labelled samples; a long token
is a secret where their log-likelihood ratio says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import spans as S
from tessera.llm.common import table, text_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN, ACCESS, HEX, RANDOM = range(4)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN_RE = rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
#: The length conditions stand in these two: a match that is too short has none that is long enough inside it.
ACCESS_RE = "AKIA[A-Z0-9]{16,}+"
HEX_RE = "[0-9a-f]{24,}+"
LEAST_VALUE = 6

#: Characters of tokens, the form of a token that the models judge, and of its parts between slashes.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_RE = "[A-Za-z0-9+/_=-]{20,}+"
PART_RE = "[A-Za-z0-9+_=-]{20,}+"
#: Least mean and total of the log-likelihood ratio (natural logarithms) over a token's transitions.
LEAST_MEAN, LEAST_TOTAL = 0.7, 20.0


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio, random against ordinary, of each transition (row by row over ALPHABET)."""

    ratio: tuple[float, ...]

    def score(self, token: Column) -> Column:
        """The sum over the token's transitions."""
        place = F.array(*(F.lit(ALPHABET.find(chr(c))) for c in range(128)))
        ratio = F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratio)), ",").cast("array<double>")
        codes = F.transform(F.split(token, ""), lambda c: F.get(place, F.ascii(c)))
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(ratio, a * len(ALPHABET) + b))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _transitions(strings: DataFrame, label: str) -> DataFrame:
    """strings(s) -> label, pair, n for pairs of ALPHABET's characters."""
    pair = F.explode(F.regexp_extract_all("s", F.lit("(?=([A-Za-z0-9+/_=-]{2}))"), F.lit(1)))
    return strings.select(pair.alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("label", F.lit(label))


def fit(docs: DataFrame, documents: int = 2000, generated: int = 20_000) -> Model:
    """Models from labelled samples.

    Ordinary: identifiers (snake case in small and in capital letters, camel case, some words numbered), paths and addresses built of the words of about `documents` documents, chosen by a hash of
    their text; words of matches of the fixed formats are left out. Random: `generated` digests written in base 64 and
    in hexadecimal, and the values that the fixed formats find in those documents. Both bounds are parameters; only
    transition counts (at most len(ALPHABET) squared a label) reach the driver. Empty docs give a model all the same.
    """
    spark = docs.sparkSession
    rows = docs.select(text_of().alias("text"))
    total = max(rows.count(), 1)
    most = min(1 << 40, int((1 << 40) * documents / total) + 1)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < most)
    fixed = f"{ASSIGN_RE}|{ACCESS_RE}|{HEX_RE}"
    words = F.regexp_extract_all(F.regexp_replace("text", fixed, " "), F.lit("[A-Za-z]{2,}+"), F.lit(0))
    named = sample.select(words.alias("w")).where(F.size("w") > 0)
    numbered = F.transform("w", lambda w, i: F.when(i % 4 == 0, F.concat(w, (i % 100).cast("string"))).otherwise(w))
    snake = F.array_join(numbered, "_")
    camel = F.array_join(F.transform(numbered, lambda w: F.initcap(w)), "")
    # a path of single words, and an address whose segments are words joined by dashes
    path = F.concat(F.lit("/"), F.array_join(numbered, "/"))
    address = F.concat(F.lit("//"), F.array_join(F.transform(numbered, lambda w, i: F.concat(F.lower(w), F.when(i % 3 == 2, "/").otherwise("-"))), ""))
    ordinary = named.select(F.explode(F.array(F.lower(snake), F.upper(snake), camel, path, F.lower(path), address)).alias("s"))
    found = sample.select(F.explode(F.regexp_extract_all("text", F.lit(f"{ACCESS_RE}|{HEX_RE}"), F.lit(0))).alias("s"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(generated)
    random = found.unionAll(made.select(F.base64(F.unhex(digest)).alias("s"))).unionAll(made.select(digest.alias("s")))
    counts: dict[str, dict[str, int]] = {"random": {}, "ordinary": {}}
    for r in _transitions(ordinary, "ordinary").unionByName(_transitions(random, "random")).collect():
        counts[r["label"]][r["pair"]] = r["n"]
    logs = []
    for label in ("random", "ordinary"):
        n = counts[label]
        sums = {a: sum(n.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        logs.append([math.log((n.get(a + b, 0) + 1) / (sums[a] + len(ALPHABET))) for a in ALPHABET for b in ALPHABET])
    return Model(tuple(x - y for x, y in zip(*logs)))


def base_spans(text: Column) -> Column:
    """Matches of the three fixed formats."""
    assign = F.filter(S.matches(text, ASSIGN_RE, ASSIGN, 1), lambda s: F.char_length(s["extra"]) >= LEAST_VALUE)
    return F.concat(assign, S.matches(text, ACCESS_RE, ACCESS), S.matches(text, HEX_RE, HEX))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, any other columns) with base and added: arrays of spans (see spans.matches).

    base: the fixed formats. added: tokens of TOKEN_RE with a letter and a digit that overlap no base span and that the
    models call random; of other tokens the segments between slashes that together are most random, and each part of
    PART_RE, judged alike. A null or empty text has none. Each row is judged alone; repeated rows alike.
    """
    text = text_of()

    def mixed(spans: Column) -> Column:
        return F.filter(spans, lambda s: s["hit"].rlike("[A-Za-z]") & s["hit"].rlike("[0-9]"))

    def free(spans: Column, others: Column) -> Column:
        return F.filter(spans, lambda s: ~S.overlaps(s, others))

    def secret(s: Column) -> Column:
        score = model.score(s["hit"])
        return F.when((score >= LEAST_TOTAL) & (score >= LEAST_MEAN * (F.char_length(s["hit"]) - 1)), True).otherwise(False)

    def judged(spans: Column) -> Column:
        return F.filter(spans, secret)

    def least(column: str, spans: Column) -> Column:
        """The spans, worked out where the column has some."""
        return F.when(F.size(column) > 0, spans).otherwise(S.none())

    found = docs.withColumn("base", base_spans(text)).withColumn("__tokens", mixed(S.matches(text, TOKEN_RE, RANDOM)))
    found = found.withColumn("__whole", least("__tokens", judged(free(F.col("__tokens"), F.col("base")))))
    found = found.withColumn("__tokens", least("__tokens", F.filter(free(F.col("__tokens"), F.col("__whole")), lambda s: F.contains(s["hit"], F.lit("/")))))
    # a token that overlaps a base span or is not random as a whole may still hold a secret
    run = F.transform("__tokens", lambda s: _densest(s, model))
    found = found.withColumn("__run", least("__tokens", judged(free(mixed(F.filter(run, lambda s: F.char_length(s["hit"]) >= 20)), F.col("base")))))
    part = mixed(S.matches(text, PART_RE, RANDOM))
    found = found.withColumn("__part", least("__tokens", judged(free(part, F.concat("base", "__whole", "__run")))))
    return found.withColumn("added", F.concat("__whole", "__run", "__part")).drop("__tokens", "__whole", "__run", "__part")


def _densest(s: Column, model: Model) -> Column:
    """The span of the token's segments between slashes whose score exceeds LEAST_MEAN a transition by most."""
    def step(acc: Column, x: Column) -> Column:
        # the slash before a segment, and the transition to it, count with the segments joined
        stop = acc["at"] + F.char_length(x)
        alone = model.score(x) - LEAST_MEAN * (F.char_length(x) - 1)
        joined = acc["sum"] + model.score(F.concat(F.right(acc["last"], F.lit(1)), F.lit("/"), x)) - LEAST_MEAN * (F.char_length(x) + 1)
        both = F.struct(alone.alias("alone"), joined.alias("joined"))
        return F.element_at(F.transform(F.array(both), lambda b: _kept(acc, x, stop, b)), 1)

    begin = F.expr("named_struct('at', 0L, 'from', 0L, 'sum', -1e9D, 'last', '', 'best', -1e18D, 'start', 0L, 'stop', 0L)")
    return F.aggregate(F.split(s["hit"], "/"), begin, step, lambda acc: F.struct(
        (s["start"] + acc["start"]).alias("start"), (s["start"] + acc["stop"]).alias("stop"), s["kind"].alias("kind"),
        F.substring(s["hit"], (acc["start"] + 1).cast("int"), (acc["stop"] - acc["start"]).cast("int")).alias("hit"), s["extra"].alias("extra")))


def _kept(acc: Column, x: Column, stop: Column, b: Column) -> Column:
    on = b["joined"] > b["alone"]
    total, start = F.greatest(b["joined"], b["alone"]), F.when(on, acc["from"]).otherwise(acc["at"])
    best = total > acc["best"]
    return F.struct(
        (stop + 1).cast("bigint").alias("at"), start.alias("from"), total.alias("sum"), x.alias("last"),
        F.greatest(total, acc["best"]).alias("best"), F.when(best, start).otherwise(acc["start"]).alias("start"), F.when(best, stop).otherwise(acc["stop"]).cast("bigint").alias("stop"))


def redact(docs: DataFrame, model: Model, mark: str = "<SECRET>") -> DataFrame:
    """docs with every secret in text replaced by mark, and n_chars (if there) counted anew.

    Rows without a secret, null and empty texts among them, stay as they are; so do other columns, whatever their names,
    and repeated rows. Each row is judged alone.
    """
    return S.redacted(docs, lambda rows: scan(rows, model), mark)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    return found.select(
        "doc_id",
        *(S.count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in (ASSIGN, ACCESS, HEX)),
        F.sha2(S.listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        S.listed(F.concat("base", "added"), KINDS).alias("spans"),
    )
