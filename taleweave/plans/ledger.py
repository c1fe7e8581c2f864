"""Task ledger, heartbeats, statistics and plans over lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.operators import ledger as op
from taleweave.plans.common import pick, sql_list, sql_pick, table
from taleweave.registry import query

_STAGE, _STATE = sql_pick(op.STAGES, "(l_partkey % 4)"), sql_pick(op.STATES, "(l_suppkey + l_orderkey)")
_TASKS = f"""tasks AS (SELECT DISTINCT ON (chapter, take, stage) * FROM (SELECT l_orderkey AS chapter, l_linenumber AS take, {_STAGE} AS stage, {_STATE} AS state, 'w' || l_suppkey % 12 AS worker,
    CASE WHEN l_partkey % 5 = 0 THEN ['w' || l_partkey % 7] ELSE [] END AS racers, 1704000000 + l_partkey % 4000 * 700 AS lease_until, CAST(l_quantity AS BIGINT) % 16 AS attempts, l_partkey, l_suppkey, l_quantity FROM lineitem)
    ORDER BY chapter, take, stage, l_partkey, l_suppkey, l_quantity)"""
_BEATS = "beats AS (SELECT 'w' || user_id % 12 AS worker, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, event_id, event_type, value FROM events)"
NOW = 1706658900
_LIVE = f"live AS (SELECT worker FROM beats GROUP BY worker HAVING {NOW} - max(ts) < 90 * 20)"


def tasks(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("take"), pick(op.STAGES, p % 4).alias("stage"), pick(op.STATES, s + F.col("l_orderkey")).alias("state"),
        F.concat(F.lit("w"), s % 12).alias("worker"), F.when(p % 5 == 0, F.array(F.concat(F.lit("w"), p % 7))).otherwise(F.array().cast("array<string>")).alias("racers"),
        (1704000000 + p % 4000 * 700).alias("lease_until"), (F.col("l_quantity").cast("long") % 16).alias("attempts"), F.struct(p, s, F.col("l_quantity")).alias("__k"),
    )
    first = {c: F.min_by(c, "__k").alias(c) for c in ("state", "worker", "racers", "lease_until", "attempts")}
    return rows.groupBy("chapter", "take", "stage").agg(*first.values())


def beats(spark, sf_dir):
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("w"), F.col("user_id") % 12).alias("worker"), ts.alias("ts"), "event_id", "event_type", "value")


def alive(spark, sf_dir):
    """Beats of the test table are minutes apart, so the clock runs at a twentieth here."""
    return op.live(beats(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / 20)), NOW // 20)


@query("a01_stage_state_counts", f"WITH {_TASKS} SELECT stage, state, count(*) AS n FROM tasks GROUP BY ALL")
def stage_state_counts(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("stage", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a02_pipeline_progress",
    f"""WITH {_TASKS}, per AS (SELECT stage, chapter, bool_and(state = 'done') AS done FROM tasks GROUP BY ALL), s AS (SELECT stage, count(*) FILTER (done) AS done, list_position({sql_list(op.STAGES)}, stage) AS k FROM per GROUP BY stage)
    SELECT stage, done, coalesce(lag(done) OVER (ORDER BY k), (SELECT count(DISTINCT chapter) FROM tasks)) AS "of" FROM s""",
)
def pipeline_progress(spark, sf_dir):
    return op.progress(tasks(spark, sf_dir))


@query("a03_state_counts", f"WITH {_TASKS} SELECT CAST(list_position({sql_list(op.STATES)}, state) AS BIGINT) AS place, state, count(*) AS n FROM tasks GROUP BY ALL")
def state_counts(spark, sf_dir):
    place = F.array_position(F.array(*[F.lit(s) for s in op.STATES]), F.col("state"))
    return tasks(spark, sf_dir).groupBy(place.alias("place"), "state").agg(F.count(F.lit(1)).alias("n"))


@query("a04_task_rollup", f"WITH {_TASKS} SELECT count(*) FILTER (state = 'done') AS done, count(*) AS total, count(*) FILTER (state NOT IN ('done', 'shelved')) AS open, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'shelved') AS shelved FROM tasks")
def task_rollup(spark, sf_dir):
    n = lambda c, name: F.count_if(c).alias(name)
    s = F.col("state")
    return tasks(spark, sf_dir).agg(n(s == "done", "done"), F.count(F.lit(1)).alias("total"), n(~s.isin("done", "shelved"), "open"), n(s == "failed", "failed"), n(s == "shelved", "shelved"))


@query(
    "a05_mode_latest_first",
    """WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_type <> 'view' GROUP BY ALL)
    SELECT user_id, arg_max(event_type, (n, first)) AS value FROM v GROUP BY user_id""",
)
def mode_latest_first(spark, sf_dir):
    """Most frequent value; on ties the one whose first occurrence is latest."""
    v = table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return v.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "first")).alias("value"))


@query("a07_upper_median", "SELECT event_type, CAST(list_sort(list(value))[count(*) // 2 + 1] AS DOUBLE) AS median FROM events GROUP BY event_type")
def upper_median(spark, sf_dir):
    """The upper middle row by rank: no group is gathered."""
    order = W.partitionBy("event_type").orderBy("value", "event_id")
    ranked = table(spark, sf_dir, "events").select("event_type", "value", F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(W.partitionBy("event_type")).alias("n"))
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("event_type", F.col("value").alias("median"))


_STATS = f"stats AS (SELECT {sql_pick(op.STAGES, '(event_id % 4)')} AS stage, event_id % 5 AS units, value AS secs, 'w' || user_id % 12 AS worker, event_id FROM events)"
_RATES = "rates AS (SELECT stage, list_sort(list(rate))[count(*) // 2 + 1] AS per_unit FROM (SELECT stage, secs / units AS rate, row_number() OVER (PARTITION BY stage ORDER BY secs / units DESC) AS k FROM stats WHERE units > 0 AND secs > 0) WHERE k <= 20 GROUP BY stage)"


def stats(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(pick(op.STAGES, e % 4).alias("stage"), (e % 5).alias("units"), F.col("value").alias("secs"), F.concat(F.lit("w"), F.col("user_id") % 12).alias("worker"), "event_id")


@query("a08_seconds_per_unit", f"WITH {_STATS}, {_RATES} SELECT stage, per_unit FROM rates")
def seconds_per_unit(spark, sf_dir):
    return op.seconds_per_unit(stats(spark, sf_dir))


@query("a09_stage_eta", f"WITH {_STATS}, {_RATES}, {_TASKS} SELECT stage, units, CAST(round(units * per_unit / 3::DOUBLE) AS BIGINT) AS secs FROM (SELECT stage, count(*) AS units FROM tasks WHERE state = 'pending' GROUP BY stage) JOIN rates USING (stage)")
def stage_eta(spark, sf_dir):
    pending = tasks(spark, sf_dir).where("state = 'pending'").groupBy("stage").agg(F.count(F.lit(1)).alias("units"))
    guess = F.lit(None).cast("double")
    for s, secs in op.FALLBACK_SECONDS.items():
        guess = F.when(F.col("stage") == s, secs).otherwise(guess)
    met = pending.join(op.seconds_per_unit(stats(spark, sf_dir)), "stage", "left")
    return met.select("stage", "units", F.round(F.col("units") * F.coalesce("per_unit", guess) / F.lit(3.0)).cast("long").alias("secs"))


@query("a10_worker_stats", f"WITH {_STATS} SELECT worker, stage, count(*) AS n FROM stats GROUP BY ALL")
def worker_stats(spark, sf_dir):
    return stats(spark, sf_dir).groupBy("worker", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("a10_recent_median", f"WITH {_STATS} SELECT stage, list_sort(list(secs))[count(*) // 2 + 1] AS median FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY event_id DESC) AS k FROM stats WHERE secs > 0) WHERE k <= 20 GROUP BY stage")
def recent_median(spark, sf_dir):
    recent = stats(spark, sf_dir).where("secs > 0").withColumn("k", F.row_number().over(W.partitionBy("stage").orderBy(F.desc("event_id")))).where("k <= 20")
    return recent.groupBy("stage").agg(op.upper_median(F.collect_list("secs")).alias("median"))


@query("a12_cast_hash", "SELECT o_custkey % 50 AS book, substr(sha256(string_agg(pair, chr(10) ORDER BY pair)), 1, 16) AS hash FROM (SELECT DISTINCT o_custkey, o_orderpriority || '|' || o_orderstatus AS pair FROM orders) GROUP BY book".replace("SELECT DISTINCT o_custkey,", "SELECT DISTINCT o_custkey % 50 AS o_custkey,"))
def cast_hash(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("book"), F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("pair")).distinct()
    return pairs.groupBy("book").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("pair")), "\n"), 256), 1, 16).alias("hash"))


@query("a13_manifest_hash", "SELECT p_size, sha256(string_agg(p_partkey || ':' || sha256(p_name), chr(10) ORDER BY p_partkey)) AS tree FROM part GROUP BY p_size")
def manifest_hash(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select("p_size", F.struct("p_partkey", F.concat("p_partkey", F.lit(":"), F.sha2("p_name", 256)).alias("line")).alias("e"))
    return entries.groupBy("p_size").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n"), 256).alias("tree"))


@query("a14_context_merge", "SELECT o_custkey AS name, arg_min(o_orderpriority, o_orderkey) AS owner, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY o_custkey")
def context_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("name")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("owner"), (F.min("o_orderpriority") != F.max("o_orderpriority")).alias("conflict"))


@query("a15_script_concat", "SELECT chapter, part, pos, row_number() OVER (PARTITION BY chapter ORDER BY part, pos) AS place FROM (SELECT conv_id // 2 AS chapter, conv_id % 2 AS part, turn AS pos FROM conversations)")
def script_concat(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 2).alias("chapter"), (F.col("conv_id") % 2).alias("part"), F.col("turn").alias("pos"))
    return t.withColumn("place", F.row_number().over(W.partitionBy("chapter").orderBy("part", "pos")).cast("long"))


@query("a19_scan_rollup", "SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS structural, count(*) FILTER (quality = 0 AND toxic = 0) AS semantic, count(*) FILTER (quality = 1) AS clean, count(*) FILTER (quality IS NULL) AS unjudged FROM documents LEFT JOIN labels USING (doc_id)")
def scan_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    return d.agg(F.count_if((q == 0) & (t == 1)).alias("structural"), F.count_if((q == 0) & (t == 0)).alias("semantic"), F.count_if(q == 1).alias("clean"), F.count_if(q.isNull()).alias("unjudged"))


@query("a20_audit_rollup", "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS findings FROM events GROUP BY user_id ORDER BY findings DESC, user_id")
def audit_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count(F.lit(1)).alias("findings"))
    return e.orderBy(F.desc("findings"), "user_id")


_HASHES = "was AS (SELECT o_orderkey AS n, upper(md5(o_orderpriority)) AS sha FROM orders WHERE o_orderkey % 3 > 0), now_ AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 7 = 0 THEN md5(o_orderstatus) ELSE md5(o_orderpriority) END AS sha FROM orders WHERE o_orderkey % 5 > 0)"
_DIFF = f"{_HASHES}, d AS (SELECT n, CASE WHEN was.sha IS NULL THEN 'create' WHEN now_.sha IS NULL THEN 'remove' WHEN lower(was.sha) = lower(now_.sha) THEN 'unchanged' ELSE 'replace' END AS change FROM was FULL JOIN now_ USING (n))"


def hashes(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    was = o.where("o_orderkey % 3 > 0").select(n.alias("n"), F.upper(F.md5("o_orderpriority")).alias("sha"))
    return was, o.where("o_orderkey % 5 > 0").select(n.alias("n"), F.when(n % 7 == 0, F.md5("o_orderstatus")).otherwise(F.md5("o_orderpriority")).alias("sha"))


@query("j15_manifest_diff", f"WITH {_DIFF} SELECT n, change FROM d")
def manifest_diff(spark, sf_dir):
    return op.diff(*hashes(spark, sf_dir), "n", "sha")


@query("j04_upload_diff", f"WITH {_DIFF} SELECT n, change AS action FROM d WHERE change <> 'remove'")
def upload_diff(spark, sf_dir):
    return op.diff(*hashes(spark, sf_dir), "n", "sha").where("change <> 'remove'").withColumnRenamed("change", "action")


@query("a21_upload_report", f"WITH {_DIFF} SELECT change, count(*) AS n FROM d WHERE change <> 'remove' GROUP BY change")
def upload_report(spark, sf_dir):
    return op.diff(*hashes(spark, sf_dir), "n", "sha").where("change <> 'remove'").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("j05_plan_reconcile", "WITH old AS (SELECT o_custkey AS key, min(o_orderkey) AS file FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), new_ AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority <> '5-LOW'), there AS (SELECT o_orderkey AS file FROM orders WHERE o_orderkey % 4 > 0) SELECT key, CASE WHEN new_.key IS NULL THEN 'stale' WHEN old.file IS NULL THEN 'new' WHEN there.file IS NULL THEN 'dirty' ELSE 'reused' END AS verdict FROM old FULL JOIN new_ USING (key) LEFT JOIN there USING (file)")
def plan_reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("file"))
    new = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("key")).distinct().withColumn("planned", F.lit(True))
    there = o.where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("file")).withColumn("there", F.lit(True))
    met = old.join(new, "key", "full_outer").join(there, "file", "left")
    verdict = F.when(F.col("planned").isNull(), "stale").when(F.col("file").isNull(), "new").when(F.col("there").isNull(), "dirty").otherwise("reused")
    return met.select("key", verdict.alias("verdict"))


_WANT = "want AS (SELECT DISTINCT l_orderkey AS chapter, l_linenumber AS take FROM lineitem), have AS (SELECT DISTINCT l_orderkey AS chapter, l_linenumber AS take FROM lineitem WHERE l_partkey % 4 > 0 AND l_orderkey % 6 > 0)"


def wanted(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("take")]
    return l.select(*key).distinct(), l.where("l_partkey % 4 > 0 and l_orderkey % 6 > 0").select(*key).distinct()


@query("j06_coverage", f"WITH {_WANT} SELECT chapter, CASE WHEN count(have.take) = 0 THEN 'none' WHEN count(have.take) = count(*) THEN 'complete' ELSE 'partial' END AS coverage FROM want LEFT JOIN have USING (chapter, take) GROUP BY chapter")
def coverage(spark, sf_dir):
    want, have = wanted(spark, sf_dir)
    met = want.join(have.withColumn("there", F.lit(1)), ["chapter", "take"], "left").groupBy("chapter").agg(F.count("there").alias("k"), F.count(F.lit(1)).alias("n"))
    return met.select("chapter", F.when(F.col("k") == 0, "none").when(F.col("k") == F.col("n"), "complete").otherwise("partial").alias("coverage"))


@query("j32_missing_takes", f"WITH {_WANT} SELECT chapter, take FROM want ANTI JOIN have USING (chapter, take)")
def missing_takes(spark, sf_dir):
    want, have = wanted(spark, sf_dir)
    return want.join(have, ["chapter", "take"], "left_anti")


@query("u06_intersect_coverage", f"WITH {_WANT} SELECT chapter, take FROM want INTERSECT SELECT chapter, take FROM have")
def intersect_coverage(spark, sf_dir):
    want, have = wanted(spark, sf_dir)
    return want.intersect(have)


@query("u03_plan_difference", f"WITH {_WANT} SELECT chapter, count(*) AS gone FROM (SELECT * FROM want EXCEPT SELECT * FROM have) GROUP BY chapter")
def plan_difference(spark, sf_dir):
    want, have = wanted(spark, sf_dir)
    return want.exceptAll(have).groupBy("chapter").agg(F.count(F.lit(1)).alias("gone"))


@query("u04_prune_rows", f"WITH {_TASKS}, {_WANT} SELECT chapter, take, stage FROM tasks ANTI JOIN have USING (chapter, take) WHERE stage = 'render'")
def prune_rows(spark, sf_dir):
    return tasks(spark, sf_dir).where("stage = 'render'").join(wanted(spark, sf_dir)[1], ["chapter", "take"], "left_anti").select("chapter", "take", "stage")


@query("u05_prune_files", f"WITH {_TASKS}, {_WANT} SELECT chapter, take FROM (SELECT * FROM want EXCEPT SELECT * FROM have) ANTI JOIN (SELECT chapter FROM tasks WHERE stage = 'render' AND state IN ('assigned', 'running')) USING (chapter)")
def prune_files(spark, sf_dir):
    want, have = wanted(spark, sf_dir)
    busy = tasks(spark, sf_dir).where("stage = 'render' and state in ('assigned', 'running')").select("chapter")
    return want.subtract(have).join(busy, "chapter", "left_anti").select("chapter", "take")


@query("u07_binding_difference", "SELECT c_custkey, list_filter(['segment', 'nation', 'balance'], lambda p: CASE p WHEN 'segment' THEN md5(c_mktsegment) <> md5('BUILDING') WHEN 'nation' THEN c_nationkey <> 7 ELSE c_acctbal < 0 END) AS pieces FROM customer")
def binding_difference(spark, sf_dir):
    pieces = F.array_compact(F.array(F.when(F.md5("c_mktsegment") != F.md5(F.lit("BUILDING")), "segment"), F.when(F.col("c_nationkey") != 7, "nation"), F.when(F.col("c_acctbal") < 0, "balance")))
    return table(spark, sf_dir, "customer").select("c_custkey", pieces.alias("pieces"))


@query("a22_remaining_range", f"WITH {_TASKS}, span AS (SELECT min(chapter) AS lo, max(chapter) AS hi FROM tasks), merged AS (SELECT DISTINCT chapter FROM tasks WHERE stage = 'merge' AND state = 'done') SELECT (SELECT min(n) FROM (SELECT unnest(range(lo, hi + 1)) AS n FROM span) WHERE n NOT IN (SELECT chapter FROM merged)) AS first, (SELECT hi FROM span) AS last, (SELECT count(*) FROM merged) AS done")
def remaining_range(spark, sf_dir):
    """The first chapter of the ledger's range that is not merged, its last chapter, and how many are merged."""
    t = tasks(spark, sf_dir)
    merged = t.where("stage = 'merge' and state = 'done'").select("chapter").distinct().withColumn("m", F.lit(True))
    low, high = t.agg(F.min("chapter"), F.max("chapter")).first()
    n = spark.range(low or 0, (high if high is not None else -1) + 1).withColumnRenamed("id", "chapter").join(merged, "chapter", "left")
    return n.agg(F.min(F.when(F.col("m").isNull(), F.col("chapter"))).alias("first"), F.max("chapter").alias("last"), F.count("m").alias("done"))


@query("a29_known_characters", "SELECT name, CASE WHEN name = 'FRANCE' THEN 0 ELSE 1 END AS place FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer UNION SELECT p_type FROM part)")
def known_characters(spark, sf_dir):
    t = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("name"))
    names = t("nation", "n_name").union(t("region", "r_name")).union(t("customer", "c_mktsegment")).union(t("part", "p_type")).distinct()
    return names.select("name", F.when(F.col("name") == "FRANCE", 0).otherwise(1).alias("place"))


@query("a30_window_weights", "SELECT conv_id, sum(length(text) + 64) AS chars, CAST(ceil(sum(length(text) + 64) / 2::DOUBLE) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def window_weights(spark, sf_dir):
    chars = F.sum(F.length("text") + 64)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(chars.alias("chars"), F.ceil(chars / 2).alias("tokens"))


@query("a31_split_summary", "SELECT conv_id, count(*) FILTER (role = 'user') AS user_lines, count(*) FILTER (role = 'assistant') AS assistant_lines, count(*) FILTER (role = 'system') AS system_lines FROM conversations GROUP BY conv_id")
def split_summary(spark, sf_dir):
    n = lambda r: F.count_if(F.col("role") == r).alias(f"{r}_lines")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n("user"), n("assistant"), n("system"))


@query("a32_timing_snapshot", "SELECT event_type AS kind, round(sum(value), 2) AS total, count(*) AS calls, round(sum(value) / count(*), 6) AS per_call FROM events GROUP BY 1")
def timing_snapshot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("calls"), F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("per_call"))


@query("a33_voice_usage", "SELECT c_nationkey AS voice, count(*) AS users, min(c_custkey) AS first FROM customer GROUP BY 1")
def voice_usage(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("voice")).agg(F.count(F.lit(1)).alias("users"), F.min("c_custkey").alias("first"))


@query("a35_stat_block", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def stat_block(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("a36_roster_completion", "SELECT conv_id, list_sort(list_distinct(list_concat(['Narrator', 'user'], list(role)))) AS roster FROM conversations GROUP BY conv_id")
def roster_completion(spark, sf_dir):
    used = F.array_union(F.array(F.lit("Narrator"), F.lit("user")), F.collect_set("role"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(used).alias("roster"))


# ---- live state ----------------------------------------------------------------------------------------------------


@query("t01_last_heartbeat", f"WITH {_BEATS} SELECT worker, max(ts) AS ts, arg_max(event_type, event_id) AS state FROM beats GROUP BY worker")
def last_heartbeat(spark, sf_dir):
    return beats(spark, sf_dir).groupBy("worker").agg(F.max("ts").alias("ts"), F.max_by("event_type", "event_id").alias("state"))


_SLOW = f"live AS (SELECT worker FROM (SELECT worker, max(ts // 20) AS ts FROM beats GROUP BY worker) WHERE {NOW // 20} - ts < 90)"


@query("t02_live_workers", f"WITH {_BEATS}, {_SLOW} SELECT worker FROM live")
def live_workers(spark, sf_dir):
    return alive(spark, sf_dir)


@query("u14_live_set", f"WITH {_BEATS}, {_SLOW} SELECT list_sort(list(worker)) AS workers FROM live")
def live_set(spark, sf_dir):
    return alive(spark, sf_dir).agg(F.array_sort(F.collect_set("worker")).alias("workers"))


_UP = "up AS (SELECT t.*, coalesce(worker IN (SELECT worker FROM live), false) OR list_has_any(racers, (SELECT list(worker) FROM live)) AS live FROM tasks t)"
_REAP = f"""{_TASKS}, {_BEATS}, {_SLOW}, {_UP}, reaped AS (SELECT chapter, take, stage, CASE WHEN lease_until < {NOW} AND len(racers) > 0 AND live THEN 'extended' WHEN lease_until < {NOW} AND live THEN 'stuck'
  WHEN lease_until < {NOW} THEN 'expired' WHEN NOT live THEN 'orphaned' END AS verdict FROM up WHERE state IN ('assigned', 'running'))"""


def reaped(spark, sf_dir):
    return op.reap(tasks(spark, sf_dir), alive(spark, sf_dir), NOW, 600)


@query("t03_lease_expiry", f"WITH {_REAP} SELECT * FROM reaped WHERE verdict IN ('extended', 'stuck', 'expired')")
def lease_expiry(spark, sf_dir):
    return reaped(spark, sf_dir).where("verdict <> 'orphaned'")


@query("t04_orphans", f"WITH {_REAP} SELECT chapter, take, stage FROM reaped WHERE verdict = 'orphaned'")
def orphans(spark, sf_dir):
    return reaped(spark, sf_dir).where("verdict = 'orphaned'").drop("verdict")


@query("j21_abandoned", f"WITH {_TASKS}, {_BEATS}, {_SLOW}, {_UP} SELECT chapter, take, stage FROM up WHERE state IN ('assigned', 'running') AND NOT live")
def abandoned(spark, sf_dir):
    known = op.with_holders(tasks(spark, sf_dir), alive(spark, sf_dir))
    return known.where(op.held(F.col("state")) & ~F.col("live")).select("chapter", "take", "stage")


@query("p35_task_filter", f"WITH {_TASKS} SELECT chapter, take, stage, state FROM tasks WHERE stage = 'render' AND state IN ('assigned', 'running') AND contains(stage || ':' || chapter || ':' || state, '17')")
def task_filter(spark, sf_dir):
    t = tasks(spark, sf_dir).where((F.col("stage") == "render") & op.held(F.col("state")))
    return t.where(F.contains(F.concat_ws(":", "stage", "chapter", "state"), F.lit("17"))).select("chapter", "take", "stage", "state")


@query(
    "j22_upstream_done",
    f"""WITH {_TASKS}, d AS (SELECT chapter, stage, bool_and(state = 'done') AS done FROM tasks GROUP BY ALL), w AS (SELECT chapter, bool_or(done) FILTER (stage = 'crawl') AS c, bool_or(done) FILTER (stage = 'digest') AS g, bool_or(done) FILTER (stage = 'render') AS r FROM d GROUP BY chapter),
    x AS (SELECT w.*, p.g AS pg FROM w LEFT JOIN w p ON p.chapter = w.chapter - 1)
    SELECT chapter, 'crawl' AS stage, true AS ready FROM x UNION ALL SELECT chapter, 'digest', coalesce(c, false) AND coalesce(pg, true) FROM x UNION ALL SELECT chapter, 'render', coalesce(g, false) FROM x UNION ALL SELECT chapter, 'merge', coalesce(r, true) FROM x""",
)
def upstream_done(spark, sf_dir):
    return op.upstream_done(tasks(spark, sf_dir))


_REPORTS = f"reports AS (SELECT l_orderkey + l_suppkey % 2 * 100000 AS chapter, l_linenumber AS take, {_STAGE} AS stage, 'w' || l_suppkey % 13 AS worker, l_partkey % 3 > 0 AS ok, CASE WHEN l_partkey % 11 = 0 THEN 'absent' ELSE '' END AS verdict, l_partkey % 13 = 0 AS terminal, l_partkey, l_suppkey FROM lineitem)"


@query("t06_completion", f"WITH {_TASKS}, {_REPORTS} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN t.worker IS NULL THEN 'unknown' WHEN NOT (t.worker = r.worker OR list_contains(t.racers, r.worker)) THEN 'stale' WHEN verdict = 'absent' THEN 'absent' WHEN terminal AND NOT ok THEN 'shelved' WHEN ok THEN 'done' ELSE 'failed' END AS outcome FROM reports r LEFT JOIN tasks t USING (chapter, take, stage)) GROUP BY outcome")
def completion(spark, sf_dir):
    return op.completion(reports(spark, sf_dir), tasks(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def reports(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + s % 2 * 100000).alias("chapter"), F.col("l_linenumber").alias("take"), pick(op.STAGES, p % 4).alias("stage"), F.concat(F.lit("w"), s % 13).alias("worker"),
        (p % 3 > 0).alias("ok"), F.when(p % 11 == 0, "absent").otherwise("").alias("verdict"), (p % 13 == 0).alias("terminal"),
    )


@query("t07_stale_reports", f"WITH {_TASKS}, {_REPORTS} SELECT r.chapter, r.take, r.stage, r.worker FROM reports r JOIN tasks t USING (chapter, take, stage) WHERE NOT (t.worker = r.worker OR list_contains(t.racers, r.worker))")
def stale_reports(spark, sf_dir):
    return op.completion(reports(spark, sf_dir), tasks(spark, sf_dir)).where("outcome = 'stale'").select("chapter", "take", "stage", "worker")


@query("t08_strikes", f"WITH {_TASKS}, f AS (SELECT chapter, take, stage, count(*) AS fails FROM (SELECT l_orderkey AS chapter, l_linenumber AS take, {_STAGE} AS stage FROM lineitem WHERE l_partkey % 3 = 0) GROUP BY ALL) SELECT chapter, take, stage, CASE WHEN fails IS NULL THEN state WHEN attempts + fails >= CASE WHEN stage = 'digest' THEN 15 ELSE 3 END THEN 'shelved' ELSE 'pending' END AS state, attempts + coalesce(fails, 0) AS attempts FROM tasks LEFT JOIN f USING (chapter, take, stage)")
def strikes(spark, sf_dir):
    failed = table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("take"), pick(op.STAGES, F.col("l_partkey") % 4).alias("stage"))
    return op.strike(tasks(spark, sf_dir), failed)


@query("t09_heal_render", f"WITH {_TASKS}, {_WANT} SELECT chapter, take FROM tasks SEMI JOIN (SELECT * FROM want EXCEPT SELECT * FROM have) USING (chapter, take) WHERE stage = 'render' AND state = 'done'")
def heal_render(spark, sf_dir):
    want, have = wanted(spark, sf_dir)
    done = tasks(spark, sf_dir).where("stage = 'render' and state = 'done'")
    return done.join(want.subtract(have), ["chapter", "take"], "left_semi").select("chapter", "take")


_MACHINE = ("online", "booting", "preparing", "offline", "error", "stopping")


@query("t10_silence", f"SELECT user_id, CASE WHEN state IN ('booting', 'preparing') THEN state ELSE 'offline' END AS state FROM (SELECT DISTINCT user_id, {sql_pick(_MACHINE, 'user_id')} AS state FROM events)")
def silence(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("state", pick(_MACHINE, F.col("user_id")))
    return m.withColumn("state", F.when(F.col("state").isin("booting", "preparing"), F.col("state")).otherwise("offline"))


@query("p48_machine_predicates", f"SELECT user_id, state = 'online' AS accepts, state IN ('booting', 'preparing') AS coming_up, state NOT IN ('stopping', 'error') AS dialable FROM (SELECT DISTINCT user_id, {sql_pick(_MACHINE, 'user_id')} AS state FROM events)")
def machine_predicates(spark, sf_dir):
    s = pick(_MACHINE, F.col("user_id"))
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", (s == "online").alias("accepts"), s.isin("booting", "preparing").alias("coming_up"), (~s.isin("stopping", "error")).alias("dialable"))


@query("t11_boot_expiry", f"WITH {_BEATS} SELECT worker, first, CASE WHEN {NOW} - last > 300 THEN 'error' ELSE 'booting' END AS state, abs({NOW} - last) <= 900 AS near_deadline FROM (SELECT worker, min(ts) AS first, max(ts) AS last FROM beats GROUP BY worker)")
def boot_expiry(spark, sf_dir):
    b = beats(spark, sf_dir).groupBy("worker").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return b.select("worker", "first", F.when(F.lit(NOW) - F.col("last") > 300, "error").otherwise("booting").alias("state"), (F.abs(F.lit(NOW) - F.col("last")) <= 900).alias("near_deadline"))


@query("t13_rate_window", f"WITH {_BEATS}, c AS (SELECT worker, ts // 60 AS ts, event_id, CAST(floor(value) AS BIGINT) AS tokens FROM beats), u AS (SELECT *, count(*) OVER w AS calls, coalesce(sum(tokens) OVER w, 0) AS spent FROM c WINDOW w AS (PARTITION BY worker ORDER BY ts RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING)) SELECT event_id, calls, CAST(spent AS BIGINT) AS spent, calls >= 3 OR spent + tokens > 300 AS wait FROM u")
def rate_window(spark, sf_dir):
    calls = beats(spark, sf_dir).select("worker", F.floor(F.col("ts") / 60).alias("ts"), "event_id", F.col("value").cast("long").alias("tokens"))
    return op.rate_waits(calls, 3, 300).select("event_id", "calls", "spent", "wait")


@query("t14_host_pacing", f"WITH {_BEATS}, k AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts, event_id) - 1 AS k FROM beats) SELECT event_id, CAST(max(ts - k * 900) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + k * 900 AS BIGINT) AS slot FROM k")
def host_pacing(spark, sf_dir):
    requests = beats(spark, sf_dir).select(F.col("worker").alias("host"), "ts", F.col("event_id").alias("id"))
    return op.paced(requests, 900).select(F.col("id").alias("event_id"), "slot")


@query("t15_repetition_window", "SELECT event_id, len(list(event_type) OVER w) AS seen, len(list_filter(list(event_type) OVER w, lambda x: x = 'error')) AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)")
def repetition_window(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-63, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("seen"), F.count_if(F.col("event_type") == "error").over(w).alias("errors"))


@query("w23_latest_events", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def latest_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(200)


@query("t16_event_ring", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def event_ring(spark, sf_dir):
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k")).where("k <= 20").drop("k")


@query("t17_state_reconcile", f"WITH {_TASKS}, {_WANT} SELECT t.chapter, t.take, t.stage, CASE WHEN h.chapter IS NOT NULL THEN 'done' WHEN state = 'done' THEN 'pending' ELSE state END AS state FROM tasks t LEFT JOIN have h USING (chapter, take)")
def state_reconcile(spark, sf_dir):
    have = wanted(spark, sf_dir)[1].withColumn("there", F.lit(True))
    t = tasks(spark, sf_dir).join(have, ["chapter", "take"], "left")
    return t.select("chapter", "take", "stage", F.when(F.col("there"), "done").when(F.col("state") == "done", "pending").otherwise(F.col("state")).alias("state"))


@query("t18_materialise_takes", f"WITH {_TASKS}, {_WANT}, r AS (SELECT chapter, take, state FROM tasks WHERE stage = 'render') SELECT chapter, take, CASE WHEN r.state IS NULL THEN 'insert' WHEN h.chapter IS NULL THEN 'delete' ELSE 'keep' END AS action FROM r FULL JOIN (SELECT chapter, take, chapter AS c FROM have) h0 USING (chapter, take) LEFT JOIN have h USING (chapter, take)")
def materialise_takes(spark, sf_dir):
    rows = tasks(spark, sf_dir).where("stage = 'render'").select("chapter", "take", F.lit(True).alias("row"))
    met = rows.join(wanted(spark, sf_dir)[1].withColumn("planned", F.lit(True)), ["chapter", "take"], "full_outer")
    return met.select("chapter", "take", F.when(F.col("row").isNull(), "insert").when(F.col("planned").isNull(), "delete").otherwise("keep").alias("action"))


@query("t19_invalidation", f"WITH {_TASKS} SELECT chapter, take, stage, CASE WHEN chapter % 9 = 0 AND stage IN ('render', 'merge') THEN 'pending' ELSE state END AS state FROM tasks")
def invalidation(spark, sf_dir):
    changed = (F.col("chapter") % 9 == 0) & F.col("stage").isin("render", "merge")
    return tasks(spark, sf_dir).select("chapter", "take", "stage", F.when(changed, "pending").otherwise(F.col("state")).alias("state"))


_DETAILS = ("retry in 53.26s", '"retryDelay": "7s"', "boom", "retry in 900s please", "429 PerDay", "429 RESOURCE_EXHAUSTED", "429 PerMinute")


@query("t24_retry_delay", rf"SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(d, 'retry in ([0-9.]+)s', 1), '') AS DOUBLE) + 2, TRY_CAST(nullif(regexp_extract(d, '\"retryDelay\":\s*\"([0-9]+)s\"', 1), '') AS DOUBLE) + 2, 60.0) AS delay FROM (SELECT event_id, {sql_pick(_DETAILS, 'event_id')} AS d FROM events)")
def retry_delay(spark, sf_dir):
    d = pick(_DETAILS, F.col("event_id"))
    number = lambda p: F.regexp_extract(d, p, 1).try_cast("double") + 2
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(number(r"retry in ([0-9.]+)s"), number(r'"retryDelay":\s*"([0-9]+)s"'), F.lit(60.0)).alias("delay"))


@query("p47_quota_class", f"SELECT event_id, CASE WHEN NOT contains(d, '429') AND NOT contains(d, 'RESOURCE_EXHAUSTED') THEN NULL WHEN contains(d, 'PerDay') THEN 'day' ELSE 'minute' END AS class FROM (SELECT event_id, {sql_pick(_DETAILS, 'event_id')} AS d FROM events)")
def quota_class(spark, sf_dir):
    d = pick(_DETAILS, F.col("event_id"))
    quota = F.contains(d, F.lit("429")) | F.contains(d, F.lit("RESOURCE_EXHAUSTED"))
    return table(spark, sf_dir, "events").select("event_id", F.when(quota & F.contains(d, F.lit("PerDay")), "day").when(quota, "minute").alias("class"))


@query("t26_reclaim", f"WITH {_TASKS} SELECT chapter, take, stage FROM tasks WHERE worker = 'w3' AND state IN ('assigned', 'running')")
def reclaim(spark, sf_dir):
    return tasks(spark, sf_dir).where((F.col("worker") == "w3") & op.held(F.col("state"))).select("chapter", "take", "stage")


@query("f46_lease_lengths", f"WITH {_TASKS} SELECT chapter, take, stage, CASE stage WHEN 'crawl' THEN 600 WHEN 'digest' THEN 1200 WHEN 'render' THEN 5400 ELSE 1800 END * least(greatest(attempts, 1), 4) AS lease FROM tasks")
def lease_lengths(spark, sf_dir):
    return tasks(spark, sf_dir).select("chapter", "take", "stage", op.lease(F.col("stage"), F.col("attempts")).alias("lease"))


@query("f45_age", f"WITH {_TASKS} SELECT chapter, take, stage, greatest(0, {NOW} - lease_until) AS age FROM tasks")
def age(spark, sf_dir):
    return tasks(spark, sf_dir).select("chapter", "take", "stage", F.greatest(F.lit(0), F.lit(NOW) - F.col("lease_until")).alias("age"))


@query("f47_task_eta", f"WITH {_STATS}, m AS (SELECT stage, list_sort(list(secs))[count(*) // 2 + 1] AS median FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY event_id DESC) AS k FROM stats WHERE secs > 0) WHERE k <= 20 GROUP BY stage), {_TASKS} SELECT chapter, take, stage, round(median * (1 - attempts / 16::DOUBLE), 4) AS eta FROM tasks JOIN m USING (stage) WHERE state = 'running'")
def task_eta(spark, sf_dir):
    running = tasks(spark, sf_dir).where("state = 'running'").join(recent_median(spark, sf_dir), "stage")
    return running.select("chapter", "take", "stage", F.round(F.col("median") * (1 - F.col("attempts") / F.lit(16.0)), 4).alias("eta"))


@query("o01_scheduler_pick", f"WITH {_TASKS} SELECT stage, chapter, take FROM tasks WHERE state = 'pending' AND stage = 'merge' ORDER BY chapter, take LIMIT 1")
def scheduler_pick(spark, sf_dir):
    return op.pick(tasks(spark, sf_dir), 1)


@query("o02_render_batch", f"WITH {_TASKS}, k AS (SELECT * FROM tasks WHERE state = 'pending' AND stage = 'render' ORDER BY chapter, take LIMIT 8) SELECT stage, chapter, take FROM k WHERE chapter = (SELECT min(chapter) FROM k)")
def render_batch(spark, sf_dir):
    return op.pick(tasks(spark, sf_dir).where("stage = 'render'"), 8)


@query("o03_next_intent", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 7 < 5 AND o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def next_intent(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_custkey % 7 < 5 and o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderdate")


@query("o06_free_voice", "SELECT c_mktsegment, arg_min(n_nationkey, (used, n_nationkey)) AS voice FROM (SELECT m.c_mktsegment, n.n_nationkey, count(c.c_custkey) AS used FROM (SELECT DISTINCT c_mktsegment FROM customer) m JOIN nation n ON n.n_nationkey % 2 = length(m.c_mktsegment) % 2 LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = m.c_mktsegment GROUP BY ALL) GROUP BY c_mktsegment")
def free_voice(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    segments = c.select("c_mktsegment").distinct().withColumn("kind", F.length("c_mktsegment") % 2)
    offered = segments.join(n.select("n_nationkey", (F.col("n_nationkey") % 2).alias("kind")), "kind")
    used = c.groupBy("c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("used"))
    met = offered.join(used, ["c_mktsegment", "n_nationkey"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return met.groupBy("c_mktsegment").agg(F.min_by("n_nationkey", F.struct("used", "n_nationkey")).alias("voice"))


@query("o10_inventory_sort", "SELECT l_orderkey, l_linenumber, sha256(l_partkey || '|' || l_suppkey) AS sha FROM lineitem ORDER BY l_orderkey, l_linenumber")
def inventory_sort(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey"), 256).alias("sha"))
    return l.orderBy("l_orderkey", "l_linenumber")


@query("w24_newest_file", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def newest_file(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("w28_first_seen", "SELECT user_id, list(event_type ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def first_seen(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]).alias("kinds"))


@query("p36_log_filter", "SELECT event_id FROM events WHERE event_type = 'error' OR contains(props, '7')")
def log_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("event_type") == "error") | F.contains("props", F.lit("7"))).select("event_id")


@query("p37_event_line", r"SELECT event_id, regexp_extract(line, '^\[([^\]]*)\] ([a-z]+):([0-9]+) done in ([0-9]+)s', 1) AS worker, regexp_extract(line, '^\[([^\]]*)\] ([a-z]+):([0-9]+) done in ([0-9]+)s', 2) AS stage, TRY_CAST(regexp_extract(line, '^\[([^\]]*)\] ([a-z]+):([0-9]+) done in ([0-9]+)s', 4) AS INTEGER) AS secs FROM (SELECT event_id, '[w' || user_id || '] ' || event_type || ':' || event_id || ' done in ' || CAST(floor(value) AS INTEGER) || CASE WHEN event_id % 5 = 0 THEN 'm' ELSE 's' END AS line FROM events)")
def event_line(spark, sf_dir):
    unit = F.when(F.col("event_id") % 5 == 0, "m").otherwise("s")
    line = F.concat(F.lit("[w"), "user_id", F.lit("] "), "event_type", F.lit(":"), "event_id", F.lit(" done in "), F.floor("value").cast("string"), unit)
    part = lambda k: F.regexp_extract(line, r"^\[([^\]]*)\] ([a-z]+):([0-9]+) done in ([0-9]+)s", k)
    return table(spark, sf_dir, "events").select("event_id", part(1).alias("worker"), part(2).alias("stage"), part(4).try_cast("int").alias("secs"))


# ---- table surgery -------------------------------------------------------------------------------------------------


@query("m01_swap_voice", "SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 99 ELSE c_nationkey END AS voice FROM customer")
def swap_voice(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") == 5, 99).otherwise(F.col("c_nationkey")).alias("voice"))


@query("m02_remerge", f"WITH {_TASKS} SELECT chapter, take, stage, CASE WHEN stage = 'merge' AND state = 'done' THEN 'pending' ELSE state END AS state FROM tasks")
def remerge(spark, sf_dir):
    again = (F.col("stage") == "merge") & (F.col("state") == "done")
    return tasks(spark, sf_dir).select("chapter", "take", "stage", F.when(again, "pending").otherwise(F.col("state")).alias("state"))


@query("m03_apply_index", f"WITH {_TASKS}, gone AS (SELECT o_orderkey AS chapter FROM orders WHERE o_orderstatus = 'P') SELECT t.chapter, t.take, t.stage, CASE WHEN g.chapter IS NOT NULL AND stage IN ('crawl', 'digest') THEN 'done' ELSE state END AS state FROM tasks t LEFT JOIN gone g USING (chapter)")
def apply_index(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("chapter"), F.lit(True).alias("gone"))
    t = tasks(spark, sf_dir).join(gone, "chapter", "left")
    return t.select("chapter", "take", "stage", F.when(F.col("gone") & F.col("stage").isin("crawl", "digest"), "done").otherwise(F.col("state")).alias("state"))


@query("m04_trim_range", f"WITH {_TASKS} SELECT chapter, take, stage FROM tasks WHERE NOT (state = 'pending' AND chapter NOT BETWEEN 100 AND 900)")
def trim_range(spark, sf_dir):
    return tasks(spark, sf_dir).where(~((F.col("state") == "pending") & ~F.col("chapter").between(100, 900))).select("chapter", "take", "stage")


@query("m05_enqueue_range", "WITH w AS (SELECT unnest(range(hi + 1)) AS chapter FROM (SELECT max(doc_id) AS hi FROM documents)), t AS (SELECT doc_id AS chapter FROM documents WHERE doc_id % 3 > 0), s AS (SELECT doc_id AS chapter FROM labels) SELECT chapter, 'crawl' AS stage, CASE WHEN t.chapter IS NULL THEN 'pending' ELSE 'done' END AS state FROM w LEFT JOIN t USING (chapter) UNION ALL SELECT chapter, 'digest', 'pending' FROM w ANTI JOIN s USING (chapter)")
def enqueue_range(spark, sf_dir):
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    want = spark.range(0, (last if last is not None else -1) + 1).withColumnRenamed("id", "chapter")
    text = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("chapter"), F.lit(True).alias("there"))
    crawl = want.join(text, "chapter", "left").select("chapter", F.lit("crawl").alias("stage"), F.when(F.col("there"), "done").otherwise("pending").alias("state"))
    script = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter"))
    return crawl.union(want.join(script, "chapter", "left_anti").select("chapter", F.lit("digest"), F.lit("pending")))


@query("m06_fix_speaker", "SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 AND turn = 1 AND role = 'assistant' THEN 'Narrator' ELSE role END AS speaker FROM conversations")
def fix_speaker(spark, sf_dir):
    hit = (F.col("conv_id") % 4 == 1) & (F.col("turn") == 1) & (F.col("role") == "assistant")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(hit, "Narrator").otherwise(F.col("role")).alias("speaker"))


@query("m07_recast", "WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'Other' ELSE role END AS speaker FROM conversations WHERE NOT (turn % 4 = 2)) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, speaker FROM k")
def recast(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    removed = c.where("turn % 4 = 2").select("conv_id", "turn")
    kept = c.join(removed, ["conv_id", "turn"], "left_anti")
    return kept.select("conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("pos"), F.when(F.col("turn") % 3 == 1, "Other").otherwise(F.col("role")).alias("speaker"))


@query("m09_requeue", f"WITH {_TASKS} SELECT chapter, take, stage, CASE WHEN state IN ('shelved', 'assigned', 'running') THEN 'pending' ELSE state END AS state, CASE WHEN state = 'shelved' THEN 0 ELSE attempts END AS attempts FROM tasks")
def requeue(spark, sf_dir):
    s = F.col("state")
    return tasks(spark, sf_dir).select("chapter", "take", "stage", F.when(s.isin("shelved", "assigned", "running"), "pending").otherwise(s).alias("state"), F.when(s == "shelved", 0).otherwise(F.col("attempts")).alias("attempts"))


@query("m12_cast_migration", "SELECT c_custkey, n_nationkey AS key, n_nationkey IS NULL AS unmigratable FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Nowhere' ELSE (SELECT lower(n_name) FROM nation WHERE n_nationkey = c_nationkey) END AS label FROM customer) LEFT JOIN (SELECT n_nationkey, lower(n_name) AS label FROM nation) USING (label)")
def cast_migration(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("label"))
    c = table(spark, sf_dir, "customer").join(n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left")
    shown = c.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "Nowhere").otherwise(F.col("label")).alias("label"))
    return shown.join(n, "label", "left").select("c_custkey", F.col("n_nationkey").alias("key"), F.col("n_nationkey").isNull().alias("unmigratable"))
