"""Snapshots: a write goes to a folder of its own, a manifest row publishes it, readers take the newest that is published.

root/data/<version>-<id> holds the rows of a version, root/manifest a small JSON file for each published one. A write that breaks off
leaves a folder that no manifest names, so nobody reads it; the row is written only after the rows are, and Spark
moves it into place whole. One writer at a time is assumed; of two rows with one version the later counts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version long, label string, folder string, rows long, updated timestamp, expired boolean"


def absent(error: AnalysisException) -> bool:
    """Whether an error says that a path is not there."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The published versions of root, one row each with its latest state; no rows where nothing was published."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    except AnalysisException as error:
        if not absent(error):
            raise
        return spark.createDataFrame([], _MANIFEST)
    return rows.groupBy("version").agg(F.max_by(F.struct("label", "folder", "rows", "updated", "expired"), F.struct(F.col("expired"), "updated", "folder")).alias("m")).select("version", "m.*")


def _row(spark: SparkSession, root: str, version: int, label: str, folder: str, rows: int, expired: bool) -> None:
    one = spark.createDataFrame([(version, label, folder, rows, expired)], "version long, label string, folder string, rows long, expired boolean")
    one.withColumn("updated", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/manifest")


def next_label(label: str | None) -> str:
    """The label after this one: a tenth more below ten (1.9, 2.0, 2.1), one more from there; 1.0 at first and after what is no number."""
    try:
        whole, _, tenth = (label or "").partition(".")
        value = int(whole) * 10 + int(tenth or 0)
    except ValueError:
        return "1.0"
    return f"{(value + 1) // 10}.{(value + 1) % 10}" if value < 100 and tenth else str(int(whole) + 1)


def publish(rows: DataFrame, root: str, keep: int | None = None) -> int:
    """Writes rows as the next version of root, publishes it, and returns its number. keep: older versions than that many expire."""
    spark = rows.sparkSession
    last = manifest(spark, root).orderBy(F.desc("version")).select("version", "label").head()
    version, label = (last["version"] + 1, next_label(last["label"])) if last else (1, "1.0")
    folder = f"data/{version:08d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    _row(spark, root, version, label, folder, spark.read.parquet(f"{root}/{folder}").count(), False)
    if keep is not None:
        expire(spark, root, keep)
    return version


def read(spark: SparkSession, root: str, version: int | None = None, fallbacks: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a published version (the newest that has not expired, or the given one).

    Where root has none, the first of fallbacks that has: each is another root of snapshots or a plain folder of Parquet.
    A version that was not published, or has expired, is an error; so is a last fallback that is not there.
    """
    found = manifest(spark, root).where(~F.col("expired"))
    row = (found if version is None else found.where(F.col("version") == version)).orderBy(F.desc("version")).head()
    if row:
        return spark.read.parquet(f"{root}/{row['folder']}")
    if version is not None:
        raise ValueError(f"{root} has no published version {version}")
    for k, other in enumerate(fallbacks):
        try:
            return read(spark, other)
        except ValueError:
            try:
                return spark.read.parquet(other)
            except AnalysisException as error:
                if not absent(error) or k == len(fallbacks) - 1:
                    raise
    raise ValueError(f"{root} has no published version")


def expire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """All versions but the newest `keep` are marked as expired and emptied; their numbers."""
    old = manifest(spark, root).where(~F.col("expired")).orderBy(F.desc("version")).offset(keep).collect()  # a row a version
    for row in old:
        _row(spark, root, row["version"], row["label"], row["folder"], row["rows"], True)  # first, so that no reader begins with it
        path = f"{root}/{row['folder']}"
        spark.createDataFrame([], spark.read.parquet(path).schema).coalesce(1).write.mode("overwrite").parquet(path)
    return sorted(row["version"] for row in old)
