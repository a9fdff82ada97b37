"""Personal data: fixed formats, and boosted trees over the spans that generous generators propose.

DataFrame functions only. Generators propose runs of digit groups, address-like strings, account numbers, dates, names
after titles and street lines, which may overlap; trees judge a proposal's format and what stands before it, a threshold
for each kind, calibrated on held-out labels, decides, and of overlapping proposals the one that holds the other or has the best score stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import boosting
from tessera.llm import spans as S
from tessera.llm.common import table, text_of

KINDS = ("email", "ip", "card", "phone", "number", "address", "account", "date", "name", "street")
EMAIL, IP, CARD, PHONE, NUMBER, ADDRESS, ACCOUNT, DATE, NAME, STREET = range(10)
#: A match may begin where the last one ended or where no character of its first class stands before it: from any
#: other place in such a run it would fail as it does from the run's start, only later.
EMAIL_RE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_RE = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_RE = r"[0-9](?:[\x20-]?[0-9])++"
PHONE_RE = r"\+[0-9][\x20().0-9-]+[0-9]"

NUMBER_RE = r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++"
ADDRESS_RE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++"
ACCOUNT_RE = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4}(?![A-Za-z0-9]))?"
DATE_RE = r"(?<![0-9.-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])"
NAME_RE = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Don)\.?\x20\p{Lu}[\p{L}'-]{1,20}(?:\x20\p{Lu}[\p{L}'-]{1,20})?"
STREET_RE = r"(?<![0-9.,])[0-9]{1,5}\x20(?:\p{Lu}\p{L}{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?![\p{L}])"
BEFORE = 24
#: Words before a number that speak for and against it.
PHONE_WORDS = "phone|tel|telephone|call|mobile|cell|fax|contact|whatsapp|dial|reach|number"
CARD_WORDS = "card|visa|mastercard|amex|credit|debit|iban|account|acct|ssn|passport|security|tax|insurance"
BIRTH_WORDS = "born|born on|birth|birthday|dob|date of birth|geboren|geb|born in|nacido|né le"
PLACE_WORDS = "at|address|lives at|live at|home|street|ship to|deliver to|sent to|signed|dear|from|to|by|patient|client"
OTHER_WORDS = "page|pages|version|isbn|issn|doi|order|invoice|price|total|year|date|time|id|ref|chapter|section|figure|table|line|size|part|item|no"
FEATURES = ("kind", "digits", "groups", "separator", "brackets", "plus", "context", "first", "last", "luhn", "dated", "glued", "words")


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits (at least one) pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.ascii(c) - 48 + F.when(i % 2 == 1, F.ascii(c) - 48 - F.when(F.ascii(c) > 52, 9).otherwise(0)).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Matches of the four fixed formats."""
    ip = F.filter(S.matches(text, IP_RE, IP), lambda s: ~F.exists(F.split(s["hit"], r"\."), lambda p: F.coalesce(p.try_cast("bigint") > 255, F.lit(True))))

    def card(s: Column) -> Column:
        d = digits_of(s["hit"])
        return F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(False)

    phone = F.filter(S.matches(text, PHONE_RE, PHONE), lambda s: F.char_length(digits_of(s["hit"])).between(10, 15))
    return F.concat(S.matches(text, EMAIL_RE, EMAIL), ip, F.filter(S.matches(text, CARD_RE, CARD), card), phone)


def proposed(text: Column) -> Column:
    """Spans of the generators, which may overlap; extra is what stands before each."""
    numbers = F.filter(S.matches(text, NUMBER_RE, NUMBER, before=BEFORE), lambda s: F.char_length(digits_of(s["hit"])).between(7, 20))
    others = ((ADDRESS_RE, ADDRESS), (ACCOUNT_RE, ACCOUNT), (DATE_RE, DATE), (NAME_RE, NAME), (STREET_RE, STREET))
    return F.concat(numbers, *(S.matches(text, pattern, kind, before=BEFORE) for pattern, kind in others))


def features(s: Column) -> list[Column]:
    """FEATURES of a proposed span: small whole numbers."""
    hit = s["hit"]
    digits = digits_of(hit)
    groups = F.split(F.regexp_replace(F.regexp_replace(hit, "^[^0-9]+", ""), "[^0-9]+", " "), " ")
    word = F.lower(s["extra"])

    def near(words: str) -> Column:
        return word.rlike(rf"(?:^|[^a-z])(?:{words})[.:#=\x20]*$")

    kinds = F.regexp_replace(hit, "[0-9+()]", "")
    return [
        s["kind"],
        F.least(F.char_length(digits), F.lit(20)),
        F.least(F.size(groups), F.lit(6)),
        F.when(kinds == "", 0).when(kinds.rlike(r"^\x20+$"), 1).when(kinds.rlike("^-+$"), 2).when(kinds.rlike(r"^\.+$"), 3).otherwise(4),
        hit.contains("(").cast("int"),
        hit.startswith("+").cast("int"),
        F.when(near(PHONE_WORDS), 1).when(near(CARD_WORDS), 2).when(near(OTHER_WORDS), 3).when(near(BIRTH_WORDS), 4).when(near(PLACE_WORDS), 5).otherwise(0),
        F.least(F.char_length(F.get(groups, F.lit(0))), F.lit(6)),
        F.least(F.char_length(F.element_at(groups, -1)), F.lit(6)),
        F.when(F.char_length(digits) >= 12, luhn(digits).cast("int")).otherwise(2),
        hit.rlike(r"^(?:19|20)[0-9]{2}[.\x20-][0-9]{1,2}[.\x20-][0-9]{1,2}|^[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2}").cast("int"),
        s["extra"].rlike("[A-Za-z0-9_]$").cast("int"),
        F.least(F.size(F.split(hit, r"\x20")), F.lit(8)),
    ]


def generated(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Labelled samples by rule: text, label; n of each shape. Digits and letters are of a hash of the sample's number."""
    d = F.lpad(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10**16)).cast("string"), 16, "0")
    w = F.translate(F.lpad(F.pmod(F.xxhash64("id", F.lit(seed), F.lit("w")), F.lit(10**12)).cast("string"), 12, "0"), "0123456789", "aeioulnrst")

    def part(a: int, k: int) -> Column:
        return F.substring(d, a, k)

    def word(a: int, k: int) -> Column:
        return F.initcap(F.substring(w, a, k))

    def year(a: int) -> Column:
        return F.concat(F.lit("19"), part(a, 2))

    def shape(*parts: Column | str) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    yes = [
        shape("tel: (", part(1, 3), ") ", part(4, 3), "-", part(7, 4)), shape("call ", part(1, 3), "-", part(4, 3), "-", part(7, 4)),
        shape("(", part(1, 3), ") ", part(4, 3), "-", part(7, 4)), shape("phone ", part(1, 3), ".", part(4, 3), ".", part(7, 4)),
        shape("mobile 0", part(1, 3), " ", part(4, 3), " ", part(7, 3)), shape("card 4", part(1, 3), " ", part(4, 4), " ", part(8, 4), " ", part(12, 4)),
        shape("ssn ", part(1, 3), "-", part(4, 2), "-", part(6, 4)),
        shape("user", part(1, 2), " [at] mail", part(3, 1), " [dot] example [dot] com"), shape("name", part(1, 3), " (at) host", part(3, 1), ".example.org"),
        shape("iban DE", part(1, 2), " ", part(3, 4), " ", part(7, 4), " ", part(9, 4), " ", part(12, 4), " ", part(2, 2)), shape("account: GB", part(1, 2), "WEST", part(3, 4), part(7, 4), part(11, 4), part(1, 2)),
        shape("born ", part(1, 1), ".1", part(2, 1), ".", year(3)), shape("dob: 0", part(1, 1), "/1", part(2, 1), "/", year(3)), shape("date of birth ", year(3), "-0", part(5, 1), "-1", part(6, 1)), shape("geboren 1", part(1, 1), ".0", part(2, 1), ".", year(3)),
        shape("dear Mr. ", word(1, 5), " ", word(6, 6)), shape("signed Dr ", word(1, 6)), shape("patient Mrs ", word(2, 7), " ", word(1, 4)), shape("client Frau ", word(4, 6)),
        shape("lives at 4", part(1, 2), " ", word(1, 6), " Street"), shape("address: 1", part(1, 3), " ", word(3, 5), " ", word(5, 4), " Road"), shape("ship to 7", part(1, 1), " ", word(2, 6), " Ave"),
    ]
    no = [
        shape("on 20", part(1, 2), "-0", part(3, 1), "-1", part(4, 1)), shape("order ", part(1, 8)), shape("isbn 978-", part(1, 1), "-", part(2, 4), "-", part(6, 4), "-", part(9, 1)),
        shape("version ", part(1, 2), ".", part(3, 3), ".", part(6, 4)), shape("total ", part(1, 7)), shape("id ", part(1, 10)), shape("it took ", part(1, 9)),
        shape("line ", part(1, 4), " ", part(5, 4)), shape("the ", part(1, 12)), shape("0", part(1, 1), ".1", part(2, 1), ".19", part(3, 2)), shape("range ", part(1, 4), "-", part(5, 4)), shape("ab", part(1, 10)), shape("x", part(1, 8)),
        shape("released 0", part(1, 1), "/1", part(2, 1), "/20", part(3, 2)), shape("updated 1", part(1, 1), ".0", part(2, 1), ".20", part(3, 2)), shape("part AB", part(1, 2), "ZZTOP", part(3, 3), " ", part(6, 4)), shape("serial XK", part(1, 2), " ", part(3, 4), " ", part(7, 4)),
        shape("item ", part(1, 3), " ", word(1, 5), " Square"), shape("page ", part(1, 2), " ", word(1, 5), " Court"),
    ]
    rows = spark.range(n)
    made = rows.select(F.explode(F.array(*(F.struct(x.alias("text"), F.lit(1).alias("label")) for x in yes), *(F.struct(x.alias("text"), F.lit(0).alias("label")) for x in no))).alias("s"))
    return made.select("s.text", "s.label")


def fit(docs: DataFrame, documents: int = 4000, samples: int = 500, precision: float = 0.9) -> boosting.Boosted:
    """Trees from labelled samples.

    Labels: of the proposals in about `documents` documents (chosen by a hash of their text), numbers and addresses that
    a fixed format covers are 1, and those with no word for personal data before them are 0; what lies between is not
    used. `samples` samples of each shape of generated have their shape's label; both bounds are parameters. A quarter,
    by a hash of the proposal, calibrates a threshold for each kind to `precision`. Only counts of feature combinations
    reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(text_of().alias("text"))
    most = min(1 << 40, int((1 << 40) * documents / max(rows.count(), 1)) + 1)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < most)
    found = sample.select(base_spans(F.col("text")).alias("base"), proposed(F.col("text")).alias("spans"))
    weak = found.select(F.explode(F.transform("spans", lambda s: F.struct(s.alias("s"), S.overlaps(s, F.col("base")).cast("int").alias("label")))).alias("x")).select("x.s", "x.label")
    ruled = generated(spark, samples).select(F.explode(proposed(F.col("text"))).alias("s"), "label")
    each = weak.withColumn("weak", F.lit(True)).unionByName(ruled.withColumn("weak", F.lit(False)))
    each = each.select(*(f.alias(n) for f, n in zip(features(F.col("s")), FEATURES)), "label", "weak", (F.pmod(F.xxhash64("s.hit"), F.lit(4)) == 0).alias("held"))
    plain = (F.col("label") == 0) & F.col("context").isin(0, 3) & F.col("kind").isin(NUMBER, ACCOUNT, DATE)
    table_ = each.where(~F.col("weak") | plain | ((F.col("label") == 1) & F.col("kind").isin(NUMBER, ADDRESS))).groupBy(*FEATURES, "label", "held").count().collect()
    if not table_:
        return boosting.Boosted(0.0, (), {})
    table_ = sorted(table_)
    x = np.array([[r[n] for n in FEATURES] for r in table_])
    return boosting.fit(x, *(np.array([r[c] for r in table_]) for c in ("label", "count", "held")), precision)


def scan(docs: DataFrame, model: boosting.Boosted) -> DataFrame:
    """docs (text, any other columns) with base and added: arrays of spans (see spans.matches).

    base: the fixed formats, which always stay. added: proposals that overlap no base span and score at least their
    kind's threshold; of overlapping ones the one that holds the other, else the one with the best score above its
    threshold, ties to the first. A null or empty text has none. Each row is judged alone; repeated rows alike.
    """
    text = text_of()
    if not model.least:
        return docs.withColumn("base", base_spans(text)).withColumn("added", S.none())
    found = docs.withColumn("base", base_spans(text)).withColumn("added", proposed(text))

    def scored(s: Column) -> Column:
        least = F.create_map(*(F.lit(v) for pair in model.least.items() for v in pair))
        over = F.when(~S.overlaps(s, F.col("base")), model.score(features(s)) - F.try_element_at(least, s["kind"]))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), over.alias("over"), s.alias("span"))

    chosen = S.best(F.filter(F.transform("added", scored), lambda c: c["over"] >= 0))
    return found.withColumn("added", F.when(F.size("added") > 0, chosen).otherwise(S.none()))


def redact(docs: DataFrame, model: boosting.Boosted, mark: str = "<PRIVATE>") -> DataFrame:
    """docs with all personal data in text replaced by mark, and n_chars (if there) counted anew.

    Rows without any, null and empty texts among them, stay as they are; so do other columns and repeated rows.
    """
    return S.redacted(docs, lambda rows: scan(rows, model), mark)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    return found.select(
        "doc_id",
        *(S.count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in (EMAIL, IP, CARD, PHONE)),
        F.sha2(S.listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        S.listed(F.concat("base", "added"), KINDS).alias("spans"),
        F.size(F.concat("base", "added")).cast("long").alias("n_spans"),
    )
