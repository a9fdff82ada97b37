"""An index in buckets by a hash of its key. An update rewrites the buckets that it falls into; other files stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the buckets that rows are of (all of a bucket's rows must be there), a sorted file each unless AQE splits it."""
    dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _last(rows: DataFrame, key: str, order: str, buckets: int, batch: int) -> DataFrame:
    """One row a key: its last by order, with the place of its first. Ties of order go by a hash of the row."""
    rest = [c for c in rows.columns if c not in (key, order)]
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("__row"), F.min(order).cast("long").alias("place"))
    return one.select(key, "__row.*", F.lit(batch).alias("batch"), "place", bucket_of(key, buckets).alias("bucket"))


def create(rows: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> None:
    """rows (key, order a whole number, others) as an index at path: one row a key, the last by order; null keys are left out.

    The index has the columns of rows but order, and batch and place: (batch, place) is where the key first came in.
    """
    _write(_last(rows, key, order, buckets, 0), path, key)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, others, batch, place: order by (batch, place) where the order of coming in matters."""
    return spark.read.parquet(path).drop("bucket")


def upsert(updates: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> list[int]:
    """updates (as rows of create, the same columns) into the index at path, made with as many buckets; the buckets rewritten.

    The last update of a key replaces its row at its place; a new key's place is behind all others, by the order in which it first came.
    Which buckets are touched is found first (at most `buckets` numbers); only these are read and written, as a
    replacement of their folders that Spark makes when all of its files are there.
    """
    spark = updates.sparkSession
    current = spark.read.parquet(path)
    batch = (current.agg(F.max("batch")).head()[0] or 0) + 1  # reads one column
    new = _last(updates, key, order, buckets, batch)
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    if not touched:
        return []
    rest = [c for c in current.columns if c not in (key, "batch", "place", "bucket")]
    both = current.where(F.col("bucket").isin(touched)).select(key, *rest, "batch", "place", "bucket").unionByName(new.select(key, *rest, "batch", "place", "bucket"))
    merged = both.repartition("bucket").groupBy("bucket", key).agg(F.max_by(F.struct(*rest), "batch").alias("__row"), F.min(F.struct("batch", "place")).alias("__at"))
    _write(merged.select(key, "__row.*", "__at.batch", "__at.place", "bucket"), path, key)
    return touched
