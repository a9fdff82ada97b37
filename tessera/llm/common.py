"""What the training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space (space, tab to carriage return).
WORD = "[^\\x20\\x09-\\x0D]+"
#: What stands between words.
BETWEEN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's spark.checkpoint.dir; on a local master without one, a folder of our own.

    A cluster without the setting is an error: executors could not read what others wrote to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there (lineage ends, lost executors cost nothing)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_of(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo modulus (null for null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
