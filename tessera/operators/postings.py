"""A persistent inverted index of bigrams: lists of places by bigram and block of documents, in segments that are added.

root/segments/<id>/postings   bigram, block, page, codes (sorted), in folders by a hash of the bigram, sorted by it
root/segments/<id>/frequencies   bigram, elements
root/segments/<id>/elements   block, doc_id, pos, content, sorted by block
root/published   which segments count, as snapshots

A list holds the elements of one block of documents and one page of places: it is bounded however common the bigram is.
"""

from __future__ import annotations

import uuid
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import snapshots

#: Folders of postings, documents of a block, places of a page (powers of two).
PARTS, DOCS, PLACES = 64, 1 << 10, 1 << 12
_SCHEMAS = {
    "postings": "bigram string, block long, page int, codes array<int>, part int",
    "frequencies": "bigram string, elements long",
    "elements": "block long, doc_id long, pos int, content string",
}


def _part(bigram: Column) -> Column:
    return (F.crc32(bigram.cast("binary")) % PARTS).cast("int")


def _published(spark: SparkSession, root: str) -> list[str]:
    """The folders of the segments that count, in the order in which they were added."""
    try:
        rows = snapshots.read(spark, f"{root}/published").orderBy("n").collect()  # a row a segment
    except ValueError:
        return []
    return [r["folder"] for r in rows]


def append(elements: DataFrame, root: str) -> int:
    """Adds elements (doc_id a whole number, pos, content) as a segment of the index at root; how many it has then.

    Documents must be new to the index (see index.new_rows). The segment counts once all of it is written: a write that
    breaks off leaves nothing that a search reads. Rows without searchable text get no postings; no rows add nothing.
    """
    spark = elements.sparkSession
    before = _published(spark, root)
    if elements.isEmpty():
        return len(before)
    folder = f"segments/{uuid.uuid4().hex}"
    path = f"{root}/{folder}"
    rows = elements.select(F.floor(F.col("doc_id") / DOCS).cast("long").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("int").alias("pos"), "content")
    rows.repartitionByRange("block", "doc_id").sortWithinPartitions("block", "doc_id", "pos").write.parquet(f"{path}/elements")
    code = (F.pmod("doc_id", F.lit(DOCS)) * PLACES + F.pmod("pos", F.lit(PLACES))).cast("int")
    held = rows.select("block", F.floor(F.col("pos") / PLACES).cast("int").alias("page"), code.alias("code"), F.explode(T.bigrams(F.col("content"))).alias("bigram"))
    lists = held.groupBy("bigram", "block", "page").agg(F.sort_array(F.collect_list("code")).alias("codes")).withColumn("part", _part(F.col("bigram")))
    lists.hint("rebalance", "part").sortWithinPartitions("part", "bigram", "block", "page").write.partitionBy("part").parquet(f"{path}/postings")
    written = spark.read.schema(_SCHEMAS["postings"]).parquet(f"{path}/postings")
    written.groupBy("bigram").agg(F.sum(F.size("codes")).alias("elements")).write.parquet(f"{path}/frequencies")
    segments = spark.createDataFrame([(k, f) for k, f in enumerate([*before, folder])], "n int, folder string")
    snapshots.publish(segments.coalesce(1), f"{root}/published", keep=2)
    return len(before) + 1


def _segments(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    parts = [spark.read.schema(_SCHEMAS[name]).parquet(f"{root}/{folder}/{name}") for folder in _published(spark, root)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def frequencies(spark: SparkSession, root: str) -> DataFrame:
    """bigram, elements: how many elements hold each bigram."""
    found = _segments(spark, root, "frequencies")
    if found is None:
        return spark.createDataFrame([], _SCHEMAS["frequencies"])
    return found.groupBy("bigram").agg(F.sum("elements").alias("elements"))


def lists(spark: SparkSession, root: str, bigrams: list[str]) -> DataFrame | None:
    """The postings of these bigrams alone: their folders are read, and in those the row groups that can hold them."""
    found = _segments(spark, root, "postings")
    parts = sorted({zlib.crc32(b.encode()) % PARTS for b in bigrams})
    return None if found is None else found.where(F.col("part").isin(parts) & F.col("bigram").isin(bigrams))


def search(spark: SparkSession, root: str, query: str, top_k: int = 10, max_chars: int = 300, within: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, snippet, relevance: what search.fulltext finds in the same elements, from the index.

    The lists of the query's bigrams meet by block and page, so what is shuffled are the lists and not their elements;
    hits are counted there. within (doc_id): only these documents. The top_k rows come to the driver, and only the
    row groups that hold them are read for their texts.
    """
    wanted = T.bigram_list(query)
    shape = "doc_id long, pos int, snippet string, relevance double"
    postings = lists(spark, root, wanted) if wanted else None
    if postings is None:
        return spark.createDataFrame([], shape)
    hits = postings.repartition("block", "page").select("block", "page", F.explode("codes").alias("code")).groupBy("block", "page", "code").agg(F.count("*").alias("n"))
    places = hits.select((F.col("block") * DOCS + F.floor(F.col("code") / PLACES)).alias("doc_id"), (F.col("page") * PLACES + F.col("code") % PLACES).cast("int").alias("pos"), F.round(F.col("n") / len(wanted), 3).alias("relevance"))
    if within is not None:
        places = places.join(within.select("doc_id"), "doc_id", "left_semi")
    best = places.orderBy(F.desc("relevance"), "doc_id", "pos").limit(top_k).collect()
    if not best:
        return spark.createDataFrame([], shape)
    top = spark.createDataFrame(best, "doc_id long, pos int, relevance double")
    texts = _segments(spark, root, "elements").where(F.col("block").isin(sorted({r["doc_id"] // DOCS for r in best})) & F.col("doc_id").isin(sorted({r["doc_id"] for r in best})))
    found = texts.join(F.broadcast(top), ["doc_id", "pos"])  # top_k rows
    return found.select("doc_id", "pos", T.preview(F.col("content"), max_chars, "…").alias("snippet"), "relevance").orderBy(F.desc("relevance"), "doc_id", "pos")
