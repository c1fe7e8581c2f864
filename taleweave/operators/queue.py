"""One tick of the queue of exclusive writes, over a snapshot of the ledger.

writes: queue, at (order of asking), id, stages, chapters (null: all). tasks: queue, chapter, take, stage, state, holders,
updated. beats: queue, worker, ts, chapter. A queue is one ledger's; queues do not wait for each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.operators import ledger as led
from taleweave.scratch import written

STAGES, FRESH, DIGESTING, SHOWN, SALTS = ("crawl", "digest", "render", "merge"), 30, 120, 4, 16


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """racing, in_way and shown of the rows (row, races) of each key. The rows that are shown are chosen within salted parts
    first, so no key is sorted in one task."""
    place = lambda *more: F.row_number().over(W.partitionBy(*keys, *more).orderBy("row"))
    few = rows.select(*keys, "row").withColumn("k", place(F.pmod(F.xxhash64("row"), F.lit(SALTS)))).where(F.col("k") <= SHOWN)
    few = few.withColumn("k", place()).where(F.col("k") <= SHOWN).groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("shown"))
    return rows.groupBy(*keys).agg(F.max("races").alias("racing"), F.count(F.lit(1)).alias("in_way")).join(few, list(keys))


def _reach(writes: DataFrame, rows: DataFrame) -> DataFrame:
    """queue, at, racing, in_way and shown of the writes in whose way any of the rows (queue, stage, chapter, row, races) are.
    Rows are summed up by stage and chapter, and for writes over all chapters by stage, before they meet the writes: a write
    meets one sum for each stage and chapter that it names, never the rows."""
    each = writes.select("queue", "at", "chapters", F.explode(F.array_distinct("stages")).alias("stage"))
    some = each.where("chapters is not null").select("queue", "at", "stage", F.explode(F.array_distinct("chapters")).alias("chapter"))
    every, by_chapter = each.where("chapters is null"), ["queue", "stage", "chapter"]
    named = rows.join(some.select(*by_chapter).distinct(), by_chapter, "left_semi")
    sums = ("queue", "at", "racing", "in_way", "shown")
    met = some.join(_summed(named, *by_chapter), by_chapter).select(*sums).unionByName(every.join(_summed(rows, "queue", "stage"), ["queue", "stage"]).select(*sums))
    shown = F.slice(F.array_sort(F.flatten(F.collect_list("shown"))), 1, SHOWN)
    return met.groupBy("queue", "at").agg(F.max("racing").alias("racing"), F.sum("in_way").alias("in_way"), shown.alias("shown"))


def blocked(writes: DataFrame, tasks: DataFrame, beats: DataFrame, now: int) -> DataFrame:
    """queue, at, racing (whether a live row or worker would race the write), in_way (held rows it reaches) and shown (the
    first of them by id). A row races if a holder beats or, digesting, it changed a little while ago; a worker on a chapter
    races a write that takes the chapter's every stage."""
    last = beats.groupBy("queue", "worker").agg(F.max_by(F.struct("ts", "chapter"), "ts").alias("b")).where(now - F.col("b.ts") < FRESH)
    fresh = last.select("queue", "worker", F.col("b.chapter").alias("on"))
    held = tasks.where(led.held(F.col("state"))).withColumn("row", F.concat_ws("/", F.col("chapter").cast("string"), F.col("stage"), F.col("take").cast("string")))
    beating = held.select("queue", "row", F.explode("holders").alias("worker")).join(fresh, ["queue", "worker"], "left_semi").select("queue", "row").distinct().withColumn("beats", F.lit(True))
    live = held.join(beating, ["queue", "row"], "left")
    races = F.coalesce("beats", F.lit(False)) | ((F.col("stage") == "digest") & (now - F.col("updated") < DIGESTING))
    sums = _reach(writes, written(live.select("queue", "stage", "chapter", "row", races.alias("races")), "held-rows"))

    whole = writes.where(F.size(F.array_intersect("stages", F.array(*[F.lit(s) for s in STAGES]))) == len(STAGES))
    on = fresh.where("on is not null").select("queue", F.lit(STAGES[0]).alias("stage"), F.col("on").alias("chapter"), F.col("worker").alias("row"), F.lit(True).alias("races"))
    owned = _reach(whole.withColumn("stages", F.array(F.lit(STAGES[0]))), on).select("queue", "at", F.lit(True).alias("owns"))
    out = writes.select("queue", "at").join(sums, ["queue", "at"], "left").join(owned, ["queue", "at"], "left")
    no = F.lit(False)
    return out.select("queue", "at", (F.coalesce("racing", no) | F.coalesce("owns", no)).alias("racing"), F.coalesce("in_way", F.lit(0)).alias("in_way"), F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))


def ticked(writes: DataFrame, tasks: DataFrame, beats: DataFrame, now: int) -> DataFrame:
    """queue, at, id, outcome (run, head, behind) and note: the longest clear prefix of each queue runs; the first blocked
    write says what is in its way, those behind how many are before them. The prefix ends at each queue's least blocked
    place, so no queue is sorted in one task."""
    state = blocked(writes, tasks, beats, now)
    stop = state.where("racing").groupBy("queue").agg(F.min("at").alias("stop"))
    rows = F.array_join("shown", ", ")
    note = F.when(F.col("in_way") == 0, "a worker is still on it").when(F.col("in_way") > SHOWN, F.concat(F.col("in_way").cast("string"), F.lit(" row(s) in the way, e.g. "), rows)).otherwise(F.concat(F.col("in_way").cast("string"), F.lit(" row(s) in the way: "), rows))
    met = writes.select("queue", "at", "id").join(state, ["queue", "at"]).join(stop, "queue", "left")
    outcome = F.when(F.col("stop").isNull() | (F.col("at") < F.col("stop")), "run").when(F.col("at") == F.col("stop"), "head").otherwise("behind")
    return met.select("queue", "at", "id", outcome.alias("outcome"), F.when(outcome == "run", "").otherwise(note).alias("note"))
