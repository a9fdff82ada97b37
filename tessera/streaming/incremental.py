"""Incremental processing with Structured Streaming: file events and daily windows (state by key: stateful)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Suffixes of files that are still being written or fetched.
UNFINISHED = ("tmp", "crdownload")


def new_files(spark: SparkSession, root: str, glob: str = "*", per_batch: int = 1000, by_folder: bool = False) -> DataFrame:
    """A stream of files as they appear under root: filename, md5, modified, content. Each file is seen once.

    Files with a suffix of UNFINISHED are left out. by_folder: a file goes by its folder's name, for writers that name their files anew
    each time, as Spark does.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    done = files.where(~F.lower("path").rlike(rf"\.({'|'.join(UNFINISHED)})$"))
    return done.select(F.element_at(F.split("path", "/"), -2 if by_folder else -1).alias("filename"), F.md5("content").alias("md5"), F.col("modificationTime").alias("modified"), "content")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand all that is there to each(batch, number), and end: for a scheduler's calls. Restarts continue at the checkpoint."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily(events: DataFrame, late: str | None = "1 day", start: str = "0 seconds") -> DataFrame:
    """events (user_id, ts, others), a stream or not -> day, user_id, n, first: tumbling days that begin at start.

    As a stream a day is final `late` after it; later rows are dropped, which is what a watermark means. None: the
    stream has its watermark already.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    return rows.groupBy(F.window("ts", "1 day", "1 day", start).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first")).select(F.col("w.start").alias("day"), "user_id", "n", "first")


def once(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows of a stream whose keys have not been seen within the watermark; of a table, one row a key."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def due_for_score(days: DataFrame, scored: DataFrame, least: int = 5) -> DataFrame:
    """Users' days with enough messages that have no score yet."""
    return days.where(F.col("n") >= least).join(scored.select("user_id", "day"), ["user_id", "day"], "left_anti")
