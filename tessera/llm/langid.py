"""Language identification: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import mapped, tidy
from tessera.llm.common import crc_bucket, table

#: Families of common languages (ISO 639-1); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Size of the hashed space of letter n-grams, and their greatest length.
DIM, LONGEST = 8192, 3
UNKNOWN = "und"
#: Bytes of text that are predicted at a time: the arrays of their n-grams take some fifty times as much.
SLICE = 250_000
_SEED = (0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed letter n-grams of all texts in sequence, how many each text has, and whether it has a letter.

    Texts are lower-cased; every run of other characters is one blank, as are a text's ends.
    """
    coded = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    length = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    chars = np.concatenate(coded) if coded else np.zeros(0, dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), length)
    letter = _letters()[chars]
    chars = np.where(letter, chars, np.uint32(0))
    keep = letter | np.concatenate([[True], letter[:-1]]) if len(chars) else letter
    chars, doc, letter = chars[keep], doc[keep], letter[keep]
    with_letter = np.bincount(doc[letter], minlength=len(texts)) > 0
    codes, owners = [], []
    for n in range(1, LONGEST + 1):
        size = len(chars) - n + 1
        if size <= 0:
            continue
        h = np.full(size, _SEED[n], dtype=np.uint32)
        for k in range(n):
            h = (h ^ chars[k : k + size]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        same = doc[:size] == doc[n - 1 :]
        codes.append((h[same] * np.uint32(0x9E3779B1)) % np.uint32(DIM))
        owners.append(doc[:size][same])
    code = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint32)
    owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
    return code.astype(np.int64), owner, with_letter


def frequencies(texts: list[str]) -> np.ndarray:
    """Relative frequencies of the hashed n-grams, a row of DIM for each text (zero for a text without letters)."""
    code, owner, with_letter = grams(texts)
    counts = np.bincount(owner * DIM + code, minlength=len(texts) * DIM).reshape(len(texts), DIM).astype(np.float32)
    counts *= with_letter[:, None]
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss, bias as a feature) by dual coordinate descent; y is 1 or -1."""
    gram = (x @ x.T).astype(np.float64)
    gram += 1.0
    alpha, margin = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * margin[i] - 1) / gram[i, i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                margin += step * y[i] * gram[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return (alpha * y) @ x, float(alpha @ y)


@dataclass
class Model:
    """Weights of all machines (DIM by machines), their biases, and which pair of families or languages each separates."""

    families: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def choose(self, names: list[str], chance: dict[tuple[str, str], np.ndarray], rows: int) -> np.ndarray:
        """The share of each of names: the mean of its pairwise chances."""
        if len(names) == 1:
            return np.ones((rows, 1))
        out = np.zeros((rows, len(names)))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            p = chance[a, b]
            out[:, i] += p
            out[:, j] += 1 - p
        return out / (len(names) - 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        code, owner, with_letter = grams(texts)
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        chance = {}
        for k, pair in enumerate(self.pairs):
            margin = np.bincount(owner, weights=self.weights[:, k][code], minlength=len(texts)) / n + self.bias[k]
            chance[pair] = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        names = sorted(self.families)
        of_family = self.choose(names, chance, len(texts))
        best = of_family.argmax(axis=1)
        said, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        inside = {name: self.choose(self.families[name], chance, len(texts)) for name in names}
        for i in np.flatnonzero(with_letter):
            own = inside[names[best[i]]][i]
            k = int(own.argmax())
            said[i] = self.families[names[best[i]]][k]
            score[i] = of_family[i, best[i]] * own[k]
        return said, score


def train(labels: list[str], x: np.ndarray) -> Model:
    """Fits every pair of families, and every pair of languages of one family."""
    model, langs = Model(), np.array(labels, dtype=object)
    for lang in sorted(set(labels)):
        model.families.setdefault(FAMILY_OF.get(lang, f"_{lang}"), []).append(lang)
    scale = 1 / max(float(np.mean([np.linalg.norm(r.astype(np.float32)) for r in x])), 1e-9) if len(x) else 1.0
    family = np.array([FAMILY_OF.get(v, f"_{v}") for v in labels], dtype=object)
    weights, bias = [], []
    for of, names in [(family, sorted(model.families))] + [(langs, v) for v in model.families.values()]:
        for a, b in combinations(names, 2):
            rows = (of == a) | (of == b)
            own = x[rows].astype(np.float32)
            own *= np.float32(scale)
            w, c = fit_svm(own, np.where(of[rows] == a, 1.0, -1.0))
            del own
            model.pairs.append((a, b))
            weights.append(w * scale)
            bias.append(c)
    if weights:
        model.weights, model.bias = np.stack(weights, axis=1).astype(np.float32), np.array(bias)
    return model


def fit(docs: DataFrame, per_lang: int = 400, languages: int = 64) -> Model:
    """A model from docs (doc_id, text, lang; rows with a null lang or doc_id teach nothing).

    per_lang bounds the sample: about that many documents of each language, chosen by a hash of doc_id (a first
    aggregation counts the languages). languages bounds the classes: the most frequent values of lang, ties by name, are
    learned, so that a column of free text cannot make a machine for every pair of its values. Only the sample's n-gram
    frequencies reach the driver.
    """
    spark = docs.sparkSession
    named = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return Model()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = spark.createDataFrame([(k, min(1 << 40, int((1 << 40) * per_lang / v) + 1)) for k, v in counts.items()], "lang string, most long")
    sample = named.join(F.broadcast(share), "lang").where(draw < F.col("most")).select("doc_id", "lang", "text")

    def work(_: pa.RecordBatch, texts: list[str]) -> dict[str, pa.Array]:
        out = [frequencies(texts[i : i + 200]) for i in range(0, len(texts), 200)]
        return {"x": pa.array([r.astype(np.float16).tobytes() for part in out for r in part], type=pa.binary())}

    # half precision, so that the sample takes little of the driver; the frequencies' own noise is greater than its steps
    found = mapped(sample, "text", work, "x binary").select("doc_id", "lang", "x").orderBy("lang", "doc_id", "x").toArrow()
    labels, x = found.column("lang").to_pylist(), np.empty((found.num_rows, DIM), dtype=np.float16)
    for k, v in enumerate(found.column("x")):
        x[k] = np.frombuffer(v.as_buffer(), dtype=np.float16)
    del found
    model = train(labels, x)
    del x
    tidy()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, any other columns) with lang_pred and score, which replace columns of the same names.

    A text without letters (null, empty, digits) is `und` with score 0; so is every text if nothing was learned.
    Each row is predicted from its own whole text alone. The model's size is DIM times the number of pairs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(_: pa.RecordBatch, texts: list[str]) -> dict[str, pa.Array]:
        said, score = shared.value.predict(texts)
        return {"lang_pred": pa.array(said, type=pa.string()), "score": pa.array(score)}

    return mapped(docs, "text", work, "lang_pred string, score double", SLICE)


def taught(docs: DataFrame) -> DataFrame:
    """The rows that may teach: crc32 of doc_id modulo 4 is not 2."""
    return docs.where(crc_bucket("doc_id", 4) != 2)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned from three quarters of the labelled rows (held_out: the rest)."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(taught(docs)))
    return found.select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, learn_from: DataFrame, per_lang: int = 200) -> DataFrame:
    """The pipeline's filter: rows whose text has a letter; `und`, that is null, empty and letterless texts, goes.

    A share of pairwise chances says which learned language is nearest, not whether any is near: a text in a language
    that was not learned stays. With nothing learned every row is `und`; per_lang as in fit. Columns stay as they are; repeated rows too.
    """
    columns = docs.columns
    kept = identify(docs.select(F.struct(*columns).alias("row"), F.col("text")), fit(taught(learn_from), per_lang))
    return kept.where(F.col("lang_pred") != UNKNOWN).select("row.*")
