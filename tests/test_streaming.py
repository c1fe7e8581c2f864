import datetime as dt

import pytest
from pyspark.sql import functions as F

from taleweave.scratch import fresh_path
from taleweave.streaming import live


@pytest.fixture
def folder(spark, data):
    """The events in three files, the second holding some of the first again."""
    path = fresh_path(spark, "events")
    e = spark.read.parquet(f"{data}/events.parquet")
    for k, part in enumerate((e.where("event_id < 400"), e.where("event_id between 350 and 700"), e.where("event_id > 700"))):
        part.coalesce(1).write.mode("append").parquet(f"{path}")
    return path


def rows(df):
    return sorted(map(repr, df.collect()))


def test_windows_equal_batch(spark, data, folder):
    got = live.drained(live.tumbling(live.without_repeats(live.event_stream(spark, folder, "3 days")), "6 hours"), fresh_path(spark, "stream"))
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = live.tumbling(batch, "6 hours")
    until = got.agg(F.max("end")).first()[0]
    assert got.count() > 20
    rounded = lambda df: df.where(F.col("end") <= F.lit(until)).select("start", "end", "event_type", "n", F.round("total", 4).alias("total"))
    assert rows(rounded(got)) == rows(rounded(want))


def test_sessions_equal_batch(spark, data, folder):
    got = live.drained(live.sessions(live.without_repeats(live.event_stream(spark, folder, "3 days")), "2 hours"), fresh_path(spark, "stream"))
    want = live.sessions(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")
    until = got.agg(F.max("end")).first()[0]
    assert rows(got.where(F.col("end") <= F.lit(until))) == rows(want.where(F.col("end") <= F.lit(until)))


def stream_of(spark, batches, schema):
    path = fresh_path(spark, "input")
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    files = spark.read.parquet(path).schema
    return spark.readStream.schema(files).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_liveness(spark):
    batches = [[(1, at(0)), (2, at(5)), (1, at(30))], [(1, at(60)), (2, at(2))], [(3, at(400))], [(3, at(900))]]
    out = live.drained(live.liveness(stream_of(spark, batches, "user_id long, ts timestamp"), 90, "0 seconds"), fresh_path(spark, "stream"), state_store=live.ROCKS)
    got = {(r.worker, r.state, (r.at - at(0)).total_seconds()) for r in out.collect()}
    assert got >= {(1, "online", 0.0), (2, "online", 5.0), (1, "offline", 150.0), (2, "offline", 95.0), (3, "online", 400.0), (3, "offline", 490.0)}


def test_leases(spark):
    batches = [[(7, 1, at(0), "ask"), (7, 2, at(1), "ask"), (8, 2, at(1), "ask")], [(7, 2, at(20), "done"), (7, 1, at(30), "done")], [(9, 3, at(2000), "ask")], [(8, 1, at(2100), "ask"), (9, 3, at(2200), "done")]]
    out = live.drained(live.leases(stream_of(spark, batches, "task long, worker long, ts timestamp, kind string"), 600, "0 seconds"), fresh_path(spark, "stream"), state_store=live.ROCKS)
    got = sorted((r.task, r.worker, r.outcome) for r in out.collect())
    assert [(7, 1, "done"), (7, 1, "granted"), (7, 2, "stale")] == [g for g in got if g[0] == 7]
    assert {(8, 2, "granted"), (8, 2, "expired"), (8, 1, "granted")} <= set(got) and {(9, 3, "granted"), (9, 3, "done")} <= set(got)
