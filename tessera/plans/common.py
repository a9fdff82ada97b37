"""Views of the driver's tables that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an index: id, title (first line), tags (language, source), subdir, category, types, status."""
    docs = documents(spark, sf_dir)
    return docs.select(
        F.col("doc_id").alias("id"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.array("lang", "source").alias("tags"), F.array("lang").alias("types"),
        F.col("source").alias("subdir"), F.col("source").alias("category"), F.when(F.col("doc_id") % 3 == 0, "active").when(F.col("doc_id") % 3 == 1, "draft").otherwise("reference").alias("status"),
    )


#: The same in SQL.
TITLED = """t AS (SELECT doc_id AS id, trim(split_part(text, chr(10), 1)) AS title, [lang, source] AS tags, [lang] AS types, source AS subdir, source AS category,
  CASE doc_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE 'reference' END AS status FROM documents)"""
LINES = """l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
e AS (SELECT doc_id, lang, source, pos, trim(raw) AS content FROM l WHERE trim(raw) <> '')"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rating submissions: user_id, day, seq, total."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), F.least(F.floor("value").cast("int"), F.lit(100)).alias("total"))


RATINGS = "r AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id AS seq, least(CAST(floor(value) AS INTEGER), 100) AS total FROM events)"
