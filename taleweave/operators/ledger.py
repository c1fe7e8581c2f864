"""The task ledger as batch snapshots: liveness, leases, transitions, progress, estimates.

tasks: chapter, take, stage, state, worker, racers, lease_until, updated, attempts. beats: worker, ts. Times are epoch
seconds. Liveness is one row per worker (map-side combined), so the joins below meet a table of workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Stages in order with their leases and limits; states in order.
STAGES = ("crawl", "digest", "render", "merge")
STATES = ("pending", "assigned", "running", "done", "failed", "shelved")
LEASES = {"crawl": 600, "digest": 1200, "render": 5400, "merge": 1800}
FALLBACK_SECONDS = {"crawl": 6.0, "digest": 45.0, "render": 22.0, "merge": 20.0}
BEAT_SECONDS, BATCH_FACTOR, RECENT = 90, 4, 20


def held(state: Column) -> Column:
    return state.isin("assigned", "running")


def lease(stage: Column, rows: Column | None = None) -> Column:
    """Seconds of a lease; a batch has that many times as long, up to four times."""
    base = F.lit(600)
    for s, seconds in LEASES.items():
        base = F.when(stage == s, seconds).otherwise(base)
    return base if rows is None else base * F.least(F.greatest(rows, F.lit(1)), F.lit(BATCH_FACTOR))


def strikes_allowed(stage: Column) -> Column:
    return F.when(stage == "digest", 15).otherwise(3)


def last_beats(beats: DataFrame) -> DataFrame:
    return beats.groupBy("worker").agg(F.max("ts").alias("ts"))


def live(beats: DataFrame, now: int) -> DataFrame:
    """Workers whose last beat is younger than 90 s."""
    return last_beats(beats).where(F.lit(now) - F.col("ts") < BEAT_SECONDS).select("worker")


def with_holders(tasks: DataFrame, alive: DataFrame) -> DataFrame:
    """tasks with `live`, whether the worker or any racer is alive. Every task becomes one row per holder and comes back by
    one aggregation on its key."""
    holders = F.array_compact(F.array_union(F.array("worker"), F.coalesce("racers", F.array().cast("array<string>"))))
    each = tasks.select("chapter", "take", "stage", F.explode(holders).alias("worker")).join(alive.withColumn("up", F.lit(True)), "worker")
    up = each.groupBy("chapter", "take", "stage").agg(F.bool_or("up").alias("live"))
    return tasks.join(up, ["chapter", "take", "stage"], "left").withColumn("live", F.coalesce("live", F.lit(False)))


def reap(tasks: DataFrame, alive: DataFrame, now: int, uptime: int) -> DataFrame:
    """Held tasks whose lease has run out or whose holders are gone, with what happens to them: extended (racers alive),
    stuck (the worker still beats: the expiry counts), expired, or orphaned (after two minutes' uptime)."""
    out = with_holders(tasks.where(held(F.col("state"))), alive)
    lapsed = F.col("lease_until") < now
    racing = F.size(F.coalesce("racers", F.array().cast("array<string>"))) > 0
    verdict = F.when(lapsed & racing & F.col("live"), "extended").when(lapsed & F.col("live"), "stuck").when(lapsed, "expired").when(~F.col("live") & F.lit(uptime > 120), "orphaned")
    return out.select("chapter", "take", "stage", verdict.alias("verdict")).where("verdict is not null")


def progress(tasks: DataFrame) -> DataFrame:
    """Per stage: chapters all of whose rows are done, and of how many (those done in the stage before; all for the first)."""
    per = tasks.groupBy("stage", "chapter").agg(F.bool_and(F.col("state") == "done").alias("done"))
    total = tasks.select("chapter").distinct().agg(F.count(F.lit(1)).alias("chapters"))
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    stages = per.groupBy("stage").agg(F.count_if("done").alias("done")).withColumn("k", order)
    before = F.lag("done").over(W.orderBy("k"))  # four rows
    return stages.join(total).select("stage", "done", F.coalesce(before, F.col("chapters")).alias("of"))


def upper_median(values: Column) -> Column:
    """The upper middle element, without interpolation."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def seconds_per_unit(stats: DataFrame) -> DataFrame:
    """Per stage the upper median of the 20 slowest rates. stats: stage, units, secs. Only 20 rows a stage are gathered."""
    rates = stats.where("units > 0 and secs > 0").withColumn("rate", F.col("secs") / F.col("units"))
    top = rates.withColumn("k", F.row_number().over(W.partitionBy("stage").orderBy(F.desc("rate")))).where(F.col("k") <= RECENT)
    return top.groupBy("stage").agg(upper_median(F.collect_list("rate")).alias("per_unit"))


def upstream_done(tasks: DataFrame) -> DataFrame:
    """chapter, stage, ready: whether all before it is done. A digest also waits for the chapter before, which counts as
    done if there is none; a chapter without render rows counts as rendered."""
    done = tasks.groupBy("chapter", "stage").agg(F.bool_and(F.col("state") == "done").alias("done"))
    flag = lambda s: F.bool_or(F.when(F.col("stage") == s, F.col("done"))).alias(s)
    wide = done.groupBy("chapter").agg(*[flag(s) for s in STAGES])
    before = wide.select((F.col("chapter") + 1).alias("chapter"), F.col("digest").alias("digest_before"))
    no, yes = F.lit(False), F.lit(True)
    w = wide.join(before, "chapter", "left").select(
        "chapter", F.lit(True).alias("crawl"), (F.coalesce("crawl", no) & F.coalesce("digest_before", yes)).alias("digest"),
        F.coalesce("digest", no).alias("render"), F.coalesce("render", yes).alias("merge"),
    )
    return w.unpivot("chapter", list(STAGES), "stage", "ready")


def completion(reports: DataFrame, tasks: DataFrame) -> DataFrame:
    """What each report (chapter, take, stage, worker, ok, verdict, terminal) does to its task."""
    known = tasks.select("chapter", "take", "stage", F.col("worker").alias("holder"), F.coalesce("racers", F.array().cast("array<string>")).alias("racers"), F.lit(True).alias("known"))
    met = reports.join(known, ["chapter", "take", "stage"], "left")
    holds = F.coalesce(F.col("holder") == F.col("worker"), F.lit(False)) | F.coalesce(F.array_contains("racers", F.col("worker")), F.lit(False))
    outcome = F.when(F.col("known").isNull(), "unknown").when(~holds, "stale").when(F.col("verdict") == "absent", "absent").when(F.col("terminal") & ~F.col("ok"), "shelved").when(F.col("ok"), "done").otherwise("failed")
    return met.select(*reports.columns, outcome.alias("outcome"))


def strike(tasks: DataFrame, failed: DataFrame) -> DataFrame:
    """tasks after the failures (chapter, take, stage) are counted: back to pending, or shelved at the stage's limit."""
    count = failed.groupBy("chapter", "take", "stage").agg(F.count(F.lit(1)).alias("fails"))
    after = F.col("attempts") + F.coalesce("fails", F.lit(0))
    state = F.when(F.col("fails").isNull(), F.col("state")).when(after >= strikes_allowed(F.col("stage")), "shelved").otherwise("pending")
    return tasks.join(count, ["chapter", "take", "stage"], "left").select("chapter", "take", "stage", state.alias("state"), after.alias("attempts"))


def pick(tasks: DataFrame, most: int) -> DataFrame:
    """The next rows to hand out: by stage order, chapter, take; then the leading run of the first row's chapter."""
    order = F.array_position(F.array(*[F.lit(s) for s in reversed(STAGES)]), F.col("stage"))
    top = tasks.where("state = 'pending'").withColumn("k", order).orderBy("k", "chapter", "take").limit(most)
    return top.withColumn("lead", F.first(F.struct("stage", "chapter")).over(W.orderBy("k", "chapter", "take"))).where(F.struct("stage", "chapter") == F.col("lead")).select("stage", "chapter", "take")


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key and change (create, replace, unchanged, remove) from one table of hashes to another, case aside."""
    a, b = before.select(key, F.lower(value).alias("__a")), after.select(key, F.lower(value).alias("__b"))
    change = F.when(F.col("__a").isNull(), "create").when(F.col("__b").isNull(), "remove").when(F.col("__a") == F.col("__b"), "unchanged").otherwise("replace")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def rate_waits(calls: DataFrame, most_calls: int, most_tokens: int, window: int = 60) -> DataFrame:
    """calls: worker, ts, id, tokens. Whether a call is over the calls or tokens of the last minute before it."""
    back = W.partitionBy("worker").orderBy("ts").rangeBetween(-window, -1)
    used = calls.withColumns({"calls": F.count(F.lit(1)).over(back), "spent": F.coalesce(F.sum("tokens").over(back), F.lit(0))})
    return used.withColumn("wait", (F.col("calls") >= most_calls) | (F.col("spent") + F.col("tokens") > most_tokens))


def paced(requests: DataFrame, pace: int) -> DataFrame:
    """requests: host, ts, id. Each host's requests at least `pace` apart, in order: slot = the greatest of ts_j + (i - j) *
    pace over all j up to i, a running maximum of ts - i * pace."""
    order = W.partitionBy("host").orderBy("ts", "id")
    k = requests.withColumn("k", F.row_number().over(order) - 1)
    slot = F.max(F.col("ts") - F.col("k") * pace).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("k") * pace
    return k.withColumn("slot", slot).drop("k")


def accepted(tasks: DataFrame, offers: DataFrame, now: int) -> DataFrame:
    """The ledger after offers (worker, stage, chapter, take; one a row) are taken up: the row is assigned to its worker with
    a lease from now on. A digest that another worker already grinds is raced: the worker joins its racers and the lease of
    all is renewed. tasks: chapter, take, stage, state, worker, racers, lease_until."""
    met = tasks.join(offers.withColumnRenamed("worker", "offered"), ["chapter", "take", "stage"], "left")
    holder = (F.col("worker") == F.col("offered")) | F.array_contains("racers", F.col("offered"))
    race = F.coalesce(F.col("offered").isNotNull() & (F.col("stage") == "digest") & held(F.col("state")) & ~holder, F.lit(False))
    takes = F.col("offered").isNotNull() & ~race
    return met.select(
        "chapter", "take", "stage", F.when(takes, "assigned").otherwise(F.col("state")).alias("state"), F.when(takes, F.col("offered")).otherwise(F.col("worker")).alias("worker"),
        F.when(race, F.array_append("racers", F.col("offered"))).otherwise(F.col("racers")).alias("racers"), F.when(F.col("offered").isNotNull(), now + lease(F.col("stage"))).otherwise(F.col("lease_until")).alias("lease_until"),
    )
