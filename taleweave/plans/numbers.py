"""Scalar time, signal, vector and key functions over events, parts and embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.functions import numbers as fn
from taleweave.plans.common import pick, sql_list, sql_pick, table
from taleweave.registry import query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


_SECS = "CAST(floor(value * 37) AS BIGINT)"


@query("f48_human", f"SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS text FROM (SELECT event_id, {_SECS} AS s FROM events)")
def human(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.human(F.floor(F.col("value") * 37)).alias("text"))


@query("f48_timestamps", "SELECT event_id, lpad(CAST(t // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST(t % 1000 AS VARCHAR), 3, '0') AS stamp FROM (SELECT event_id, CAST(floor(value * 12345) AS BIGINT) AS t FROM events)")
def timestamps(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.timestamp(F.floor(F.col("value") * 12345)).alias("stamp"))


@query("f49_ticks", f"SELECT event_id, CAST(round(value * {fn.TICKS_PER_SECOND}) AS BIGINT) AS ticks, CAST(round(value * 24.0::DOUBLE) AS BIGINT) * CAST(round({fn.TICKS_PER_SECOND}.0::DOUBLE / 24.0) AS BIGINT) AS snapped FROM events")
def ticks(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.ticks(F.col("value")).alias("ticks"), fn.frame_ticks(F.col("value"), F.lit(24.0)).alias("snapped"))


@query("f50_loop_copies", "SELECT event_id, CASE WHEN clip > 0 AND value > clip THEN CAST(greatest(ceil((value - x) / greatest(clip - x, 1e-6)), 2) AS INTEGER) END AS copies FROM (SELECT *, least(greatest(0.5::DOUBLE, 0.0), clip / 4) AS x FROM (SELECT event_id, value, CAST(event_id % 9 AS DOUBLE) AS clip FROM events))")
def loop_copies(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.loop_copies(F.col("value"), (F.col("event_id") % 9).cast("double"), F.lit(0.5)).alias("copies"))


def _clip(at: float) -> str:
    return f"least(greatest((value - {at}::DOUBLE) / 2.0::DOUBLE, 0.0), 1.0)"


@query("f51_gain", f"SELECT event_id, round(0.2::DOUBLE + 0.5::DOUBLE * {_clip(8.0)} - 0.5::DOUBLE * {_clip(18.0)} + 0.5::DOUBLE * {_clip(58.0)} - 0.5::DOUBLE * {_clip(78.0)}, 9) AS gain FROM events")
def gain(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(fn.gain(F.col("value"), 0.2, 0.7, 2.0, 2.0, [(10.0, 20.0), (60.0, 80.0)]), 9).alias("gain"))


_CURVES = ("linear", "in", "out", "in-out", "in-cubic", "out-cubic", "in-out-cubic", "in-sin", "out-sin", "in-out-sin")
_EASE = f"""CASE c WHEN 'in' THEN u * u WHEN 'out' THEN 1 - (1 - u) * (1 - u) WHEN 'in-out' THEN CASE WHEN u < 0.5 THEN 2 * u * u ELSE 1 - 2 * (1 - u) * (1 - u) END WHEN 'in-cubic' THEN u * u * u
  WHEN 'out-cubic' THEN 1 - pow(1 - u, 3) WHEN 'in-out-cubic' THEN CASE WHEN u < 0.5 THEN 4 * u * u * u ELSE 1 - pow(2 - 2 * u, 3) / 2 END WHEN 'in-sin' THEN 1 - cos(u * {math.pi / 2}) WHEN 'out-sin' THEN sin(u * {math.pi / 2})
  WHEN 'in-out-sin' THEN (1 - cos({math.pi} * u)) / 2 ELSE u END"""


@query("f52_easing", f"SELECT event_id, {_EASE} BETWEEN -1e-9 AND 1 + 1e-9 AS inside, CAST(floor({_EASE} * 100 + 1e-7) AS BIGINT) AS percent FROM (SELECT event_id, {sql_pick(_CURVES, 'event_id')} AS c, least(greatest(value / 100::DOUBLE, 0.0), 1.0) AS u FROM events)")
def easing(spark, sf_dir):
    eased = fn.ease(pick(_CURVES, F.col("event_id")), F.col("value") / 100)
    return events(spark, sf_dir).select("event_id", eased.between(-1e-9, 1 + 1e-9).alias("inside"), F.floor(eased * 100 + F.lit(1e-7)).alias("percent"))


@query("f52_motion", "SELECT event_id, round(CASE WHEN u < 6 THEN CASE WHEN k % 2 = 1 THEN 3.0 - 2.0 * (u - k) * (u - k) ELSE 1.0 + 2.0 * (u - k) * (u - k) END ELSE 1.0 END, 9) AS value FROM (SELECT event_id, value / 4.0::DOUBLE AS u, CAST(floor(value / 4.0::DOUBLE) AS BIGINT) AS k FROM events)")
def motion(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(fn.moved(F.col("value"), 1.0, 3.0, 4.0, 6, True, "in"), 9).alias("value"))


@query("f53_dot", "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[len(embedding) + 1 - i] AS DOUBLE))), 9) AS dot FROM embeddings")
def dot(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(fn.dot(F.col("embedding"), F.reverse("embedding")), 9).alias("dot"))


@query("f54_softmax", "SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 9)) AS p FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings)")
def softmax(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.transform(fn.softmax(F.col("embedding")), lambda p: F.round(p, 9)).alias("p"))


@query("f55_repetition_penalty", "SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: round(CASE WHEN i - 1 IN (0, 3, 5) THEN CASE WHEN embedding[i] < 0 THEN CAST(embedding[i] AS DOUBLE) * 1.5 ELSE CAST(embedding[i] AS DOUBLE) / 1.5 END ELSE CAST(embedding[i] AS DOUBLE) END, 9)) AS x FROM embeddings")
def repetition_penalty(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return vectors(spark, sf_dir).select("vec_id", F.transform(fn.penalise(logits, F.array(F.lit(0), F.lit(3), F.lit(5)), 1.5), lambda x: F.round(x, 9)).alias("x"))


@query("f56_quantise", "SELECT event_id, CAST(round(least(greatest(value / 50, 0.0), 8.0) * 1024) AS INTEGER) AS fine, CAST(round(least(greatest(value / 50, 0.0), 8.0) * 16) AS INTEGER) AS coarse FROM events")
def quantise(spark, sf_dir):
    v = F.col("value") / 50
    return events(spark, sf_dir).select("event_id", fn.quantise(v, 1024).alias("fine"), fn.quantise(v, 16).alias("coarse"))


@query("f59_take_key", "SELECT conv_id, turn, substr(sha256(array_to_string(['take-v1', 'local', role, '0.8000|0.1500', text], chr(0))), 1, 16) AS key FROM conversations")
def take_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.take_key(F.lit("local"), F.col("role"), F.col("text"), F.lit(0.8), F.lit(0.15)).alias("key"))


@query("f60_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("f62_inject_gain", "SELECT event_id, CASE event_type WHEN 'click' THEN 1.0::DOUBLE ELSE 0.1 END AS gain, CASE WHEN value > 50 THEN value ELSE 1.0 END AS level FROM events")
def inject_gain(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "click", 1.0).otherwise(0.1).alias("gain"), F.when(F.col("value") > 50, F.col("value")).otherwise(1.0).alias("level"))


@query("f63_pause_padding", "SELECT event_id, greatest(0, 12000 - CAST(floor(value * 480) AS BIGINT)) AS samples FROM events")
def pause_padding(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.greatest(F.lit(0), F.lit(12000) - F.floor(F.col("value") * 480)).alias("samples"))


@query("f30_frame_cap", rf"SELECT doc_id, CAST(CASE WHEN s <= 4 AND n <= 24 * s THEN least(24 + 2 * n, 13 + 5 * (s - 1)) ELSE 24 + 2 * n END AS INTEGER) AS cap FROM (SELECT doc_id, length(w) AS n, greatest(len(regexp_extract_all(w, '[{fn.VOWELS}]+')), 1) AS s FROM (SELECT doc_id, lower(regexp_extract(text, '([^ ]+)', 1)) AS w FROM documents))")
def frame_cap(spark, sf_dir):
    w = F.lower(F.regexp_extract("text", "([^ ]+)", 1))
    return table(spark, sf_dir, "documents").select("doc_id", fn.frame_cap(F.length(w), F.greatest(F.regexp_count(w, F.lit(f"[{fn.VOWELS}]+")), F.lit(1))).alias("cap"))


@query("o08_top_k", "SELECT vec_id, list_sort(embedding, 'DESC')[1:10] AS top FROM embeddings")
def top_k(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.slice(F.sort_array("embedding", False), 1, 10).alias("top"))


@query("o09_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS at FROM embeddings")
def argmax(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("at"))


@query("o12_best_generation", "SELECT user_id, arg_min(event_id, (event_type = 'error', value, event_id)) AS best FROM events GROUP BY user_id")
def best_generation(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", F.struct((F.col("event_type") == "error").alias("bad"), "value", "event_id")).alias("best"))


@query("o13_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50")
def page(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(50).limit(25)


@query(
    "w22_nucleus",
    """WITH p AS (SELECT vec_id, unnest(range(len(e))) AS i, unnest(e) / s AS p FROM (SELECT *, list_sum(e) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings))),
    c AS (SELECT *, round(coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS before FROM p)
    SELECT vec_id, count(*) AS kept FROM c WHERE before < 0.7 GROUP BY vec_id""",
)
def nucleus(spark, sf_dir):
    p = vectors(spark, sf_dir).select("vec_id", F.posexplode(fn.softmax(F.col("embedding"))).alias("i", "p"))
    before = F.sum("p").over(W.partitionBy("vec_id").orderBy(F.desc("p"), "i").rowsBetween(W.unboundedPreceding, -1))
    return p.withColumn("before", F.round(F.coalesce(before, F.lit(0.0)), 9)).where("before < 0.7").groupBy("vec_id").agg(F.count(F.lit(1)).alias("kept"))


@query("a23_percentile", "SELECT event_type, round(quantile_cont(CAST(value AS DOUBLE), 0.3), 6) AS p30, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentile(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.percentile("value", 0.3), 6).alias("p30"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


_SAMPLES = "s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def samples(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@query("a24_envelope", f"WITH {_SAMPLES} SELECT vec_id, i // 4 AS frame, max(abs(x)) AS level FROM s GROUP BY ALL")
def envelope(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("vec_id", F.floor(F.col("i") / 4).alias("frame")).agg(F.max(F.abs("x")).alias("level"))


@query("a25_crest_factor", f"WITH {_SAMPLES} SELECT vec_id, round(CASE WHEN avg(x * x) > 0 THEN max(abs(x)) / sqrt(avg(x * x)) END, 8) AS crest FROM s GROUP BY vec_id")
def crest_factor(spark, sf_dir):
    power = F.avg(F.col("x") * F.col("x"))
    return samples(spark, sf_dir).groupBy("vec_id").agg(F.round(F.when(power > 0, F.max(F.abs("x")) / F.sqrt(power)), 8).alias("crest"))


@query(
    "a27_bursts",
    f"""WITH {_SAMPLES}, b AS (SELECT vec_id, i // 4 AS k, round(sqrt(avg(x * x)), 9) AS rms FROM s GROUP BY ALL), loud AS (SELECT vec_id, k FROM (SELECT *, max(rms) OVER (PARTITION BY vec_id) AS peak FROM b) WHERE rms > peak * 0.5),
    runs AS (SELECT vec_id, k, sum(fresh) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY vec_id ORDER BY k) <= 2 THEN 0 ELSE 1 END AS fresh FROM loud))
    SELECT vec_id, count(*) AS bursts FROM (SELECT vec_id, run, max(k) - min(k) + 1 AS n FROM runs GROUP BY ALL) WHERE n >= 2 GROUP BY vec_id""",
)
def bursts(spark, sf_dir):
    """Blocks above half the peak, gaps of one block bridged, runs of two blocks or more."""
    b = samples(spark, sf_dir).groupBy("vec_id", F.floor(F.col("i") / 4).alias("k")).agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 9).alias("rms"))
    order = W.partitionBy("vec_id").orderBy("k")
    loud = b.withColumn("peak", F.max("rms").over(W.partitionBy("vec_id"))).where(F.col("rms") > F.col("peak") * 0.5)
    fresh = F.when(F.col("k") - F.lag("k").over(order) <= 2, 0).otherwise(1)
    runs = loud.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    long = runs.groupBy("vec_id", "run").agg((F.max("k") - F.min("k") + 1).alias("n")).where("n >= 2")
    return long.groupBy("vec_id").agg(F.count(F.lit(1)).alias("bursts"))


@query("a28_edge_silence", f"WITH {_SAMPLES}, b AS (SELECT vec_id, i // 4 AS k, avg(abs(x)) AS level FROM s GROUP BY ALL) SELECT vec_id, 4 * min(k) FILTER (level > 0.08) AS lead, 4 * (max(k) - max(k) FILTER (level > 0.08)) AS tail FROM b GROUP BY vec_id")
def edge_silence(spark, sf_dir):
    b = samples(spark, sf_dir).groupBy("vec_id", F.floor(F.col("i") / 4).alias("k")).agg(F.avg(F.abs("x")).alias("level"))
    loud = F.when(F.col("level") > 0.08, F.col("k"))
    return b.groupBy("vec_id").agg((4 * F.min(loud)).alias("lead"), (4 * (F.max("k") - F.max(loud))).alias("tail"))


@query("p42_triage_flags", f"WITH {_SAMPLES} SELECT vec_id, list_filter([CASE WHEN max(abs(x)) >= 0.25 THEN 'clipping' END, CASE WHEN abs(avg(x)) > 0.02 THEN 'dc offset' END, CASE WHEN max(abs(x)) < 0.2 THEN 'no onset' END], lambda f: f IS NOT NULL) AS flags FROM s GROUP BY vec_id")
def triage_flags(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.max(F.abs("x")) >= 0.25, "clipping"), F.when(F.abs(F.avg("x")) > 0.02, "dc offset"), F.when(F.max(F.abs("x")) < 0.2, "no onset")))
    return samples(spark, sf_dir).groupBy("vec_id").agg(flags.alias("flags"))


_GATES = ("crawl", "digest", "render")


@query("p49_policy_gates", f"SELECT user_id, stage FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest({sql_list(_GATES)}) AS stage) WHERE (stage <> 'render' OR user_id % 3 = 0) AND (stage <> 'digest' OR user_id % 2 = 0) AND user_id * 7 % 100 < 90")
def policy_gates(spark, sf_dir):
    w, stage = F.col("user_id"), F.col("stage")
    each = events(spark, sf_dir).select("user_id").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in _GATES])))
    return each.where(((stage != "render") | (w % 3 == 0)) & ((stage != "digest") | (w % 2 == 0)) & (w * 7 % 100 < 90))


@query("x05_sound_judge", "SELECT event_id, value / 491 < 0.2 AS doubt, event_id = min(event_id) FILTER (value / 491 < 0.2) OVER (PARTITION BY user_id) AS complains FROM events")
def sound_judge(spark, sf_dir):
    doubt = F.col("value") / 491 < 0.2
    first = F.min(F.when(doubt, F.col("event_id"))).over(W.partitionBy("user_id"))
    return events(spark, sf_dir).select("event_id", doubt.alias("doubt"), (F.col("event_id") == first).alias("complains"))


@query("x09_prompt_sections", r"SELECT doc_id, regexp_replace(regexp_replace('# Text' || chr(10) || '{{text}}' || chr(10) || '# Cast' || chr(10) || '{{cast}} {{gone}}', '\{\{text\}\}', regexp_replace(text, '[^a-z ]', '', 'g')), '\{\{cast\}\}', source) AS prompt FROM documents")
def prompt_sections(spark, sf_dir):
    out = F.lit("# Text\n{{text}}\n# Cast\n{{cast}} {{gone}}")
    out = F.replace(out, F.lit("{{text}}"), F.regexp_replace("text", "[^a-z ]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(out, F.lit("{{cast}}"), F.col("source")).alias("prompt"))
