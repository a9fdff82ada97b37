"""Ranked search over elements and over document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def narrowed(docs: DataFrame, scope: str | None = None, doc_type: str | None = None) -> DataFrame:
    """Rows whose category holds scope and whose doc_type is doc_type (where given): pushed to the scan."""
    if scope:
        docs = docs.where(F.col("category").contains(scope))
    return docs.where(F.col("doc_type") == doc_type) if doc_type else docs


def fulltext(elements: DataFrame, query: str, top_k: int = 10, max_chars: int = 300) -> DataFrame:
    """elements (doc_id, pos, content, others) by the share of the query's bigrams that they hold.

    A bigram is held exactly if the element's searchable text contains it, so the score is a sum of contains(): one
    pass without arrays, Python or shuffle, and a bounded top-k at the end. Ties stay in order of document and place.
    """
    wanted = T.bigram_list(query)
    if not wanted:
        return elements.limit(0).select("doc_id", "pos", F.lit("").alias("snippet"), F.lit(0.0).alias("relevance"))
    hits = F.lit(0)
    for b in wanted:
        hits = hits + F.contains("__s", F.lit(b)).cast("int")
    # rows without a hit are dropped after the top-k, where they come last: a filter before it would be pushed below the
    # projection and work the searchable text out once for each bigram
    scored = elements.withColumn("__s", T.searchable(F.col("content"))).withColumn("__n", hits)
    found = scored.select("doc_id", "pos", T.preview(F.col("content"), max_chars, "…").alias("snippet"), F.round(F.col("__n") / len(wanted), 3).alias("relevance"), (F.col("__n") > 0).alias("__hit"))
    return found.orderBy(F.desc("relevance"), F.desc("__hit"), "doc_id", "pos").limit(top_k).where("__hit").drop("__hit")


def metadata(docs: DataFrame, query: str, top_k: int = 5) -> DataFrame:
    """docs (id, title, tags, subdir, others) with score: 3 for the title (4 at its start), 2 a tag, 1 the subdir."""
    q = query.strip().lower()
    title = F.lower("title")
    score = (
        F.when(title.startswith(q), 4).when(title.contains(q), 3).otherwise(0)
        + 2 * F.size(F.filter("tags", lambda t: F.lower(t).contains(q)))
        + F.lower("subdir").contains(q).cast("int")
    )
    return docs.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(top_k)


def retrieval(docs: DataFrame, query: str) -> DataFrame:
    """docs (id, title, category, types, tags, status) with score and matched_fields, ranked with active documents first."""
    q = query.lower()

    def holds(c: Column) -> Column:
        return F.lower(c).contains(q)

    types, tags = F.filter("types", holds), F.filter("tags", holds)
    in_category, in_title = F.coalesce(holds(F.col("category")), F.lit(False)), F.coalesce(holds(F.col("title")), F.lit(False))
    score = 10 * in_category.cast("int") + 5 * F.size(types) + 3 * F.size(tags) + 8 * in_title.cast("int")
    none = F.expr("cast(array() as array<string>)")
    fields = F.concat(
        F.when(in_category, F.array(F.concat(F.lit("category="), F.col("category")))).otherwise(none),
        F.transform(types, lambda t: F.concat(F.lit("type="), t)),
        F.transform(tags, lambda t: F.concat(F.lit("tag="), t)),
        F.when(in_title, F.array(F.lit("title"))).otherwise(none),
    )
    priority = F.when(F.col("status") == "active", 3).when(F.col("status") == "draft", 2).when(F.col("status") == "reference", 1).otherwise(0)
    return docs.withColumn("score", score).withColumn("matched_fields", fields).withColumn("priority", priority).where("score > 0")


def keyword_context(lines: DataFrame, keywords: list[str], around: int = 2) -> DataFrame:
    """lines (doc_id, pos, content) that hold a keyword: the first in the keywords' order, and the lines around.

    Only lines with a keyword, and their neighbours, are carried on: each goes to the places whose context it is in.
    """
    marked = lines.select("doc_id", "pos", "content", T.first_of(F.col("content"), keywords).alias("keyword"))
    hits = marked.where("keyword IS NOT NULL").select("doc_id", F.col("pos").alias("at"), "keyword")
    wanted = hits.select("doc_id", "at", "keyword", F.explode(F.sequence(F.col("at") - around, F.col("at") + around)).alias("pos"))
    near = wanted.join(lines.select("doc_id", "pos", "content"), ["doc_id", "pos"])
    context = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    return near.groupBy("doc_id", "at").agg(F.first("keyword").alias("keyword"), context.alias("context")).select("doc_id", (F.col("at") + 1).alias("line_number"), "keyword", "context")


def ranked(found: DataFrame, *order: Column) -> DataFrame:
    """found (the few rows of a top-k) with rank, from 1, by order."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def summary_first(summary: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """All of summary, and of detail what has no row there."""
    return summary.unionByName(detail.join(summary.select(key).distinct(), key, "left_anti"))
