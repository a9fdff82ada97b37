"""State by key in Spark's state store: files as they change, are sent and come back, and scores at a time of day."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The processors travel by value: the Python process in which the driver prepares state does not see packages shipped to executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_DAY = 86_400_000


def use_state_store(spark: SparkSession) -> None:
    """State variables need the RocksDB store; a provider that the session names already stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, None) or ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Files(StatefulProcessor):
    """The digest of a file, and whether what was sent is under way, completed or failed."""

    def __init__(self, wait_ms: int | None) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "md5 string, status string")
        self.sent = handle.getValueState("sent", "md5 string", self.wait_ms)  # goes by itself after wait_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        md5, status = self.seen.get() if self.seen.exists() else (None, None)
        waiting = self.sent.exists()
        before = (md5, status)
        for row in sorted(rows, key=lambda r: r["at"]):
            if row["status"] is not None:  # the outcome of what was sent last; of nothing sent, nothing
                status = status and row["status"]
                waiting = False
                continue
            same = row["md5"] == md5
            if md5 is None:
                reason = "new"
            elif not same:
                reason = "changed"
            elif status == "completed":
                reason = "unchanged"
            elif status == "sent" and waiting:
                reason = "waiting"
            else:
                reason = "retry"
            if reason not in ("unchanged", "waiting"):
                md5, status, waiting = row["md5"], "sent", True
            yield Row(filename=key[0], at=row["at"], md5=row["md5"], reason=reason)
        if (md5, status) != before:
            self.seen.update((md5, status))
        if status == "sent" and waiting:
            self.sent.update((md5,))
        else:
            self.sent.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def tracked(events: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """events (filename, at, md5, status), a stream -> filename, at, md5, reason of each file that was found.

    A row without status says that a file with this digest was found; one with a status (completed, failed) tells the
    outcome of what was sent of it last. reason: new, changed (another digest than the last sent), retry (the last one failed, or was not
    heard of for wait_ms), unchanged (completed with this digest), waiting (sent and not heard of yet). Only the first
    three are to be sent. State is one small row a file; a batch's rows of one file are put in order by `at` in memory.
    An outcome of a file that was never found counts for nothing. A restart goes on where the checkpoint is.
    wait_ms is a time to live by the clock, for queries that run on: with it a query that is to end with what is
    available never does, as the clock always moves.
    """
    use_state_store(events.sparkSession)
    rows = events.select("filename", "at", "md5", "status")
    return rows.groupBy("filename").transformWithState(_Files(wait_ms), "filename string, at long, md5 string, reason string", "append", "None" if wait_ms is None else "ProcessingTime")


def synced(files: DataFrame, outcomes: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """tracked() over a stream of files (filename, md5, modified) and one of outcomes (filename, at in milliseconds, status)."""
    found = files.select("filename", F.unix_millis("modified").alias("at"), "md5", F.lit(None).cast("string").alias("status"))
    told = outcomes.select("filename", F.col("at").cast("long").alias("at"), F.lit(None).cast("string").alias("md5"), "status")
    return tracked(found.unionByName(told), wait_ms)


class _Gate(StatefulProcessor):
    """Messages of each open day, whether it is scored, and a timer at the day's gate."""

    def __init__(self, least: int, gate_ms: int) -> None:
        self.least, self.gate_ms = least, gate_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "n long, scored boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        counts: dict[int, list] = {}
        for row in rows:
            ms = row["ms"]
            day = ms // _DAY
            if ms - day * _DAY < self.gate_ms:
                if day not in counts:
                    counts[day] = list(self.days.getValue((day,))) if self.days.containsKey((day,)) else [0, False, True]
                counts[day][0] += not row["scored"]
                counts[day][1] |= bool(row["scored"])
        for day, (n, scored, *first) in counts.items():
            if first:
                self.handle.registerTimer(day * _DAY + self.gate_ms)
            self.days.updateValue((day,), (n, scored))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        day = expiredTimerInfo.getExpiryTimeInMs() // _DAY
        if self.days.containsKey((day,)):
            n, scored = self.days.getValue((day,))
            self.days.removeKey((day,))
            if n >= self.least and not scored:
                yield Row(user_id=key[0], day=date(1970, 1, 1) + timedelta(days=day), n=n)

    def close(self) -> None:
        pass


def scores_due(messages: DataFrame, late: str = "2 hours", least: int = 5, gate: str = "17:20") -> DataFrame:
    """messages (user_id, ts, scored), a stream -> user_id, day, n: who is to be scored at the gate of a day, once a day.

    Counted are a day's messages before the gate (UTC); a row with scored set is a score that was given, and its day
    needs no other. A timer at the gate fires when the watermark, `late` behind the last row, passes it: rows that are no
    later than that count. A day's state goes with its timer.
    """
    use_state_store(messages.sparkSession)
    hours, minutes = map(int, gate.split(":"))
    rows = messages.select("user_id", "ts", F.unix_millis("ts").alias("ms"), "scored").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithState(_Gate(least, (hours * 60 + minutes) * 60_000), "user_id long, day date, n long", "append", "EventTime")
