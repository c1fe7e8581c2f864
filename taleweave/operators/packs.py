"""Packs that build on each other: closure, layered merge, withdrawal, renames, updates.

deps: name, dep, pos (order of naming). entries: pack, member, key, value, mode (whole, key, list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.scratch import written


def closure(deps: DataFrame, root: str) -> DataFrame:
    """name, depth, direct: every pack that root reaches, at its greatest distance, so that deeper (weaker) ones come
    first. A level per round over written tables. A path without a loop has no more steps than there are packs that name
    others, so a level beyond that means that a pack reaches itself."""
    level = written(deps.where(F.col("name") == root).select(F.col("dep").alias("name"), F.lit(1).alias("depth")).distinct(), "closure")
    found, depth, most = level, 1, deps.select("name").distinct().count()
    while not level.isEmpty():
        if depth > most:
            raise ValueError("a pack depends on itself")
        depth += 1
        level = written(level.select("name").join(deps, "name").select(F.col("dep").alias("name"), F.lit(depth).alias("depth")).distinct(), "closure")
        found = found.union(level)
    direct = deps.where(F.col("name") == root).select(F.col("dep").alias("name"), F.lit(True).alias("direct")).distinct()
    out = found.groupBy("name").agg(F.max("depth").alias("depth")).join(direct, "name", "left")
    return out.select("name", "depth", F.coalesce("direct", F.lit(False)).alias("direct"))


def layered(entries: DataFrame, strength: DataFrame) -> DataFrame:
    """member, key, value, from the packs by strength (pack, rank; the highest wins). mode whole: the strongest pack that
    has the member gives all of it; key: each key by itself; list: all values, the strongest pack's first."""
    e = entries.join(strength, "pack")
    top = e.withColumn("top", F.max("rank").over(W.partitionBy("member")))
    whole = top.where("mode = 'whole' and rank = top").select("member", "key", "value")
    keyed = e.where("mode = 'key'").groupBy("member", "key").agg(F.max_by("value", "rank").alias("value"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "key", "value")))
    lists = e.where("mode = 'list'").groupBy("member").agg(F.array_join(F.transform(parts, lambda x: x["value"]), ",").alias("value")).select("member", F.lit("").alias("key"), "value")
    return whole.union(keyed).union(lists)


def withdraw(live: DataFrame, recorded: DataFrame) -> DataFrame:
    """key, action: what an earlier merge wrote (key, hash) and nobody has changed is withdrawn; a changed value is adopted;
    one that is gone stays gone; all else is the pack's own."""
    met = live.join(recorded, "key", "full_outer")
    action = F.when(F.col("hash").isNull(), "own").when(F.col("value").isNull(), "gone").when(F.sha2("value", 256) == F.col("hash"), "withdrawn").otherwise("adopted")
    return met.select("key", action.alias("action"))


def renames(steps: DataFrame, most: int = 64) -> DataFrame:
    """old, new: chains of renames followed to their end, by pointer jumping: each round doubles the steps followed."""
    now = written(steps.select("old", "new"), "renames")
    for _ in range(most):
        onward = now.select(F.col("old").alias("new"), F.col("new").alias("later"))
        nxt = written(now.join(onward, "new", "left").select("old", F.coalesce("later", "new").alias("new")), "renames")
        if nxt.exceptAll(now).isEmpty():
            return nxt
        now = nxt
    raise ValueError("renames go round in a circle")


def applied(names: DataFrame, renamed: DataFrame) -> DataFrame:
    """old, new, outcome per rename: apply (old is there), keep (new is there already), missing (neither)."""
    have = names.select("name").distinct()
    r = renamed.join(have.select(F.col("name").alias("old"), F.lit(True).alias("a")), "old", "left").join(have.select(F.col("name").alias("new"), F.lit(True).alias("b")), "new", "left")
    return r.select("old", "new", F.when(F.col("b"), "keep").when(F.col("a"), "apply").otherwise("missing").alias("outcome"))


def updates(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """name, plan: new, up to date, update, or drift (the installed tree is not what was installed)."""
    met = wanted.select("name", F.col("hash").alias("want")).join(installed.select("name", "hash", "live"), "name", "left")
    plan = F.when(F.col("hash").isNull(), "new").when(F.col("live") != F.col("hash"), "drift").when(F.col("hash") == F.col("want"), "up to date").otherwise("update")
    return met.select("name", plan.alias("plan"))
