"""Session helpers shared by tests, the bench and local runs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library assumes (UTC, AQE, Arrow)."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach, under spark.checkpoint.dir; on a local master without one, our own.

    A cluster without the setting is an error: executors could not read what others wrote to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return f"{context.getCheckpointDir()}/tessera-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's folder (our own only where none is set): lineage ends, lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to path, over what is there, and read again: for loops whose state is joined with itself many times.

    A checkpoint keeps the size that the optimizer guessed for its plan. Guesses for joins are products, so over many
    rounds they become numbers of millions of digits in the driver; files have the size that they have.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package (once a context), for functions that run in their Python workers.

    A job that was submitted with the package on every worker's path does not need it, and it does no harm there.
    """
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._tessera_shipped = True
