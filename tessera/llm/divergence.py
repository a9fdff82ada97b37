"""Source divergence audit: joint count histograms of the terms of two sources, one evaluation a combination of counts.

Terms are counted per (lang, source) once; the terms of a language that enough documents hold make its table of counts.
For each pair of sources the cells (count here, count there) are tallied with how many terms have them. Cells in which
both counts are positive come from the table, in blocks of sources; cells with a zero follow from each source's own
histogram and the size of the vocabulary, so that no zero is ever stored. The divergence is then the sum of the cells'
values times their multiplicities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import slices, small_batches, tidy
from tessera.llm.common import cut, table, text_of

#: Bytes of a term become themselves (A-Z in lower case), all others a blank: terms are runs of ASCII letters and of non-ASCII characters.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Documents of a language that a term of its vocabulary is in, at least.
LEAST_DOCUMENTS = 30
#: Terms that a worker counts before it passes them on, sources of a block, slices that the terms of a pair of blocks are dealt to.
_HELD, _BLOCK, _SLICES = 400_000, 48, 16
_SCALE, _PRIOR = 1_000_000_000, 5


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (rows that hold it), the sum over all rows still to be taken.

    Each worker adds up what it has read and passes it on from time to time, so a group of many rows is small before it is shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                terms = list(n)
                for at in range(0, len(terms), 100_000):
                    part = terms[at : at + 100_000]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, type=pa.binary()), pa.array([n[t] for t in part], type=pa.int64()), pa.array([d[t] for t in part], type=pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])
            counts.clear()

        for part, texts in slices(batches, "text"):
            langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
            for text, lang, source in zip(texts, langs, sources):
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                words = text.encode("utf-8", "surrogatepass").translate(_TERMS).split()
                before = len(n)
                n.update(words)
                d.update(set(words))
                held += len(n) - before
            if held >= _HELD:
                yield from flush()
                held = 0
        yield from flush()
        tidy()

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, d long")


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, cells (source, n): each language's terms that `least` of its rows hold, with their counts by source.

    A row is bounded by the number of sources. The counts are summed up by source first, then by term.
    """
    by_source = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return by_term.where(F.col("d") >= least).select("lang", F.col("term").cast("string").alias("term"), "cells")


def chance(n: Column, total: Column, terms: Column) -> Column:
    """p: 1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly; wide decimals hold the product."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(n + _PRIOR) * F.lit(_SCALE).cast("decimal(10,0)"), wide(total + F.lit(_PRIOR) * terms))


def joint_cells(terms: DataFrame) -> DataFrame:
    """lang, a, b (sources, a before b), na, nb (both above zero), m: how many terms of the language have these two counts.

    Sources are dealt to blocks by a hash; a term's row goes once to every pair of its blocks, and the terms of a pair of
    blocks to several tasks. A task holds the table of a slice of terms over two blocks, and tallies pair by pair.
    """
    sources = terms.select("lang", F.explode("cells.source").alias("source")).distinct().groupBy("lang").count()
    blocks = -(-(sources.agg(F.max("count")).head()[0] or 1) // _BLOCK)  # of the language with the most sources: one number, no join by language
    spread = F.pmod(F.xxhash64("source"), F.lit(blocks))
    cells = terms.where(F.size("cells") > 1).select("lang", "term", F.explode("cells").alias("cell")).select("lang", "term", F.col("cell.source"), F.col("cell.n"))
    parts = cells.groupBy("lang", "term", spread.alias("block")).agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    whole = parts.groupBy("lang", "term").agg(F.collect_list(F.struct("block", "cells")).alias("parts"))
    left = whole.select("lang", "term", F.explode("parts").alias("x"), "parts")
    pairs = left.select("lang", "term", "x", F.explode(F.filter("parts", lambda p: p["block"] >= F.col("x.block"))).alias("y"))
    dealt = pairs.select("lang", F.col("x.block").alias("i"), F.col("y.block").alias("j"), F.pmod(F.xxhash64("term"), F.lit(_SLICES)).alias("slice"), F.col("x.cells").alias("a"), F.col("y.cells").alias("b"))
    tallied = dealt.repartition("lang", "i", "j", "slice").mapInArrow(_tally, "lang string, a string, b string, na long, nb long, m long")
    return tallied.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))


def _dense(cells: pa.ListArray) -> tuple[list[str], np.ndarray]:
    """The sources in byte order and the table of counts, a row for each term."""
    flat = cells.flatten()
    names = flat.field("source").dictionary_encode()
    order = sorted(range(len(names.dictionary)), key=lambda k: names.dictionary[k].as_py().encode())
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(order), len(cells)), dtype=np.int64)
    out[place[names.indices.to_numpy(zero_copy_only=False)], row] = flat.field("n").to_numpy(zero_copy_only=False)
    return [names.dictionary[k].as_py() for k in order], out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tallies each batch's terms, pair of blocks by pair of blocks; sums over batches are taken after the shuffle."""
    for batch in batches:
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist()))
        for key in dict.fromkeys(keys):
            rows = batch.filter(pa.array([k == key for k in keys]))
            lang, i, j = key
            names_a, a = _dense(rows.column("a"))
            names_b, b = (names_a, a) if i == j else _dense(rows.column("b"))
            known = [np.unique(x, return_inverse=True) for x in b]
            for s, x in enumerate(a):
                values, inverse = np.unique(x, return_inverse=True)
                for t in range(s + 1 if i == j else 0, len(b)):
                    other, at = known[t]
                    both = (x > 0) & (b[t] > 0)
                    if not both.any():
                        continue
                    code, m = np.unique(inverse[both] * len(other) + at[both], return_counts=True)
                    left, right, na, nb = names_a[s], names_b[t], values[code // len(other)], other[code % len(other)]
                    if right.encode() < left.encode():
                        left, right, na, nb = right, left, nb, na
                    columns = [pa.array([v] * len(code)) for v in (lang, left, right)] + [pa.array(v, type=pa.int64()) for v in (na, nb, m)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "na", "nb", "m"])
    tidy()


def pair_divergence(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, a, b, value for every pair of a language's sources (a before b); groups: lang, source, total, terms.

    The joint cells, those with a zero included, are evaluated once each. A cell (n, 0) holds the terms that one source
    has n times less those of its joint cells; (0, 0) what is left of the vocabulary.
    """
    own = terms.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.source").alias("source"), F.col("cell.n").alias("n")).agg(F.count("*").alias("m"))
    x = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "terms")
    y = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    pairs = x.join(y, "lang").where(F.col("a") < F.col("b"))
    joint = joint_cells(terms)
    zero = F.lit(0).cast("long")
    minus = F.explode(F.array(F.struct("na", zero.alias("nb"), (-F.col("m")).alias("m")), F.struct(zero.alias("na"), F.col("nb"), (-F.col("m")).alias("m")), F.struct(zero.alias("na"), zero.alias("nb"), F.col("m")), F.struct("na", "nb", "m")))
    cells = joint.select("lang", "a", "b", minus.alias("c")).select("lang", "a", "b", "c.*")
    rows = pairs.select("lang", "a", "b")
    here = rows.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("na"), zero.alias("nb"), "m")
    there = rows.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", zero.alias("na"), F.col("n").alias("nb"), "m")
    nothing = here.union(there).select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), (-F.col("m")).alias("m"))
    all_terms = pairs.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), F.col("terms").alias("m"))
    tallied = cells.union(here).union(there).union(nothing).union(all_terms).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))
    f = F.abs(chance(F.col("na"), F.col("total_a"), F.col("terms")) - chance(F.col("nb"), F.col("total_b"), F.col("terms")))
    found = pairs.where(F.col("terms") > 0).join(tallied.where(F.col("m") != 0), ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("value"))
    return rows.join(found, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", zero).alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others, and by which terms.

    docs has text, lang, source (null: ""), and any other columns, which are not read. Part `pair` ranks all other
    sources of the language; part `term` the first `most` terms that the source uses more than its language does. Repeated rows
    count each; ties go by item in byte order. A language without a kept term has pairs of value 0 and no terms; a
    source without terms takes part like any other. An empty table gives no rows.
    """
    docs = docs.select(text_of().alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source"))
    terms = cut(vocabulary(docs, least))
    size = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = terms.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = cut(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms")))
    pairs = cut(pair_divergence(groups, terms))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("of_lang"))
    used = terms.select("lang", "term", F.aggregate("cells.n", zero, lambda t, n: t + n).alias("n_lang"), F.explode("cells").alias("cell"))
    used = used.select("lang", "term", "n_lang", F.col("cell.source").alias("source"), F.col("cell.n").alias("n")).join(groups, ["lang", "source"]).join(whole, "lang")
    value = chance(F.col("n"), F.col("total"), F.col("terms")) - chance(F.col("n_lang"), F.col("of_lang"), F.col("terms"))
    over = used.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where(F.col("value") > 0)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part, df: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked("pair", both).union(ranked("term", over).where(F.col("rank") <= most))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language of documents against its others, and its 50 most overused terms."""
    return divergence(table(spark, sf_dir, "documents"))


_P = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * {terms})"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS of_lang FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(total), 0)::HUGEINT AS total, coalesce(any_value(terms), 0) AS terms, coalesce(any_value(of_lang), 0) AS of_lang
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", total="g.total", terms="g.terms")} AS p, {_P.format(n="k.n", total="g.of_lang", terms="g.terms")} AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM s WHERE part = 'pair' OR rank <= 50
"""
