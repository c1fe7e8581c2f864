"""Streams of heartbeats and reports: liveness, leases, windows, duplicates, rates.

Every function takes a streaming (or batch) frame and returns one; sources and sinks are the caller's. Event time is a
TIMESTAMP column `ts`; state is kept per worker or task and is bounded by watermarks and timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, late: str = "30 minutes", files_per_trigger: int = 1) -> DataFrame:
    """events tables of a folder as a stream, ts as event time, with the watermark that all below go by."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, length: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum per window and event type."""
    grouped = events.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Bursts of one user with no pause of `gap`."""
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame) -> DataFrame:
    """Exact repeats of a report (event_id) within the watermark arrive once."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


class Liveness(StatefulProcessor):
    """One row of state per worker: its last beat and a timer `silence` ms after it. Emits online at the first beat (again),
    offline when the timer runs out; an older beat changes nothing."""

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        beats = sorted(ms for batch in rows for ms in batch["ms"].tolist())
        kept = self.last.get()
        before = last = kept[0] if kept else None
        out = []
        for ms in beats:
            if last is not None and ms > last + self.silence:  # rows come before the timers of their batch
                out.append((key[0], "offline", last + self.silence))
                last = None
            if last is None:
                out.append((key[0], "online", ms))
            last = ms if last is None else max(last, ms)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.silence)
            self.last.update((last,))
            self.handle.registerTimer(last + self.silence)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.last.clear()
        yield self._rows([(key[0], "offline", at)])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["worker", "state", "ms"])


TRANSITIONS = StructType([StructField("worker", LongType()), StructField("state", StringType()), StructField("ms", LongType())])


def liveness(beats: DataFrame, silence_seconds: int = 90, late: str = "1 minute") -> DataFrame:
    """worker, state, at: when each worker (user_id) comes online and falls silent. Needs the RocksDB state store."""
    own = beats.withWatermark("ts", late).select(F.col("user_id").alias("worker"), "ts", F.unix_millis("ts").alias("ms"))
    told = own.groupBy("worker").transformWithStateInPandas(Liveness(silence_seconds * 1000), TRANSITIONS, "append", "EventTime")
    return told.select("worker", "state", F.timestamp_millis("ms").alias("at"))


class Leases(StatefulProcessor):
    """One row of state per task: who holds it until when. A task is granted to the first asker; a report of another worker
    is stale; a lease that runs out gives the task back."""

    def __init__(self, length: int) -> None:
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holder = handle.getValueState("holder", StructType([StructField("worker", LongType()), StructField("until", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = pd.concat(list(rows)).sort_values(["ts", "worker"])
        out = []
        for r in asked.itertuples():
            now, held = int(pd.Timestamp(r.ts).timestamp() * 1000), self.holder.get() if self.holder.exists() else None
            if held is not None and now >= held[1]:  # rows come before the timers of their batch
                out.append((key[0], int(held[0]), "expired"))
                self.handle.deleteTimer(held[1])
                self.holder.clear()
                held = None
            if r.kind == "ask" and held is None:
                self.holder.update((int(r.worker), now + self.length))
                self.handle.registerTimer(now + self.length)
                out.append((key[0], int(r.worker), "granted"))
            elif r.kind == "done":
                mine = held is not None and held[0] == int(r.worker)
                out.append((key[0], int(r.worker), "done" if mine else "stale"))
                if mine:
                    self.handle.deleteTimer(held[1])
                    self.holder.clear()
        if out:
            yield pd.DataFrame(out, columns=["task", "worker", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.holder.exists():
            worker = int(self.holder.get()[0])
            self.holder.clear()
            yield pd.DataFrame({"task": [key[0]], "worker": [worker], "outcome": ["expired"]})

    def close(self) -> None:
        pass


def leases(requests: DataFrame, seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """requests: task, worker, ts, kind (ask, done). Returns task, worker, outcome (granted, done, stale, expired)."""
    schema = StructType([StructField("task", LongType()), StructField("worker", LongType()), StructField("outcome", StringType())])
    own = requests.withWatermark("ts", late).select("task", "worker", "ts", "kind")
    return own.groupBy("task").transformWithStateInPandas(Leases(seconds * 1000), schema, "append", "EventTime")


def drained(stream: DataFrame, folder: str, mode: str = "append", state_store: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; folder holds its output and checkpoints."""
    spark = stream.sparkSession
    if state_store:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", state_store)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
