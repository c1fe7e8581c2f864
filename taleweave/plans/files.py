"""Sources and sinks: tables go out in each format and are read back, or a source's decision is made over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleweave.plans.common import S, table
from taleweave.registry import query
from taleweave.scratch import fresh_path
from taleweave.sources import files


@query("s01_chapter_scan", "SELECT doc_id, length(text) AS chars FROM documents")
def chapter_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))


@query("s03_json_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_round_trip(spark, sf_dir):
    path, rows = fresh_path(spark, "customers"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("s04_stats_append", "SELECT stage, count(*) AS n, sum(units) AS units FROM (SELECT event_type AS stage, greatest(event_id % 5, 1) AS units FROM events UNION ALL SELECT event_type, greatest(event_id % 5, 1) FROM events WHERE event_id % 2 = 0) GROUP BY stage")
def stats_append(spark, sf_dir):
    path, e = fresh_path(spark, "stats"), table(spark, sf_dir, "events")
    for rows in (e, e.where("event_id % 2 = 0")):
        files.append_stats(rows.select(F.col("event_type").alias("stage"), (F.col("event_id") % 5).alias("units"), F.col("value").alias("secs"), F.col("event_id").alias("ts"), F.lit("w").alias("worker")), path)
    return files.stats(spark, path).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query("s05_stats_scan", "SELECT event_id AS ts FROM events WHERE event_id % 7 > 1")
def stats_scan(spark, sf_dir):
    """Blank and broken lines fall out."""
    path, k = fresh_path(spark, "lines"), F.col("event_id") % 7
    good = F.to_json(F.struct(F.col("event_type").alias("stage"), F.lit(1).alias("units"), F.col("value").alias("secs"), F.col("event_id").alias("ts"), F.lit("w").alias("worker")))
    table(spark, sf_dir, "events").select(F.when(k == 0, "").when(k == 1, '{"stage": ').otherwise(good).alias("value")).write.text(path)
    return files.stats(spark, path).select("ts")


@query("s07_page_scan", "SELECT page_id, url, strlen(html) AS bytes FROM pages")
def page_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("bytes"))


@query("s09_charset_decode", "SELECT page_id, html AS text FROM pages")
def charset_decode(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 3
    single = F.encode("html", "UTF-8")
    wide = F.encode("html", "UTF-16LE")
    raw = p.select("page_id", F.when(k == 0, wide).otherwise(single).alias("content"), F.when(k == 0, "text/html; charset=utf-16le").otherwise("text/html").alias("content_type"))
    return files.decoded(raw).select("page_id", "text")


@query("s16_spine_index", rf"SELECT doc_id, regexp_extract(text, '^([^\n]*)', 1) AS title, length(text) AS chars, substr(text, 1, 160) AS head FROM documents")
def spine_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), F.length("text").cast("long").alias("chars"), F.substring("text", 1, 160).alias("head"))


@query(
    "s17_book_range",
    rf"""WITH RECURSIVE parts AS (SELECT conv_id AS book, trim(text, ' ') AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
    run AS (
      SELECT book, k, p AS b FROM parts WHERE k = 1
      UNION ALL SELECT x.book, x.k, CASE WHEN r.b = '' THEN x.p WHEN ends_with(r.b, '-') THEN left(r.b, length(r.b) - 1) || x.p
        WHEN NOT regexp_matches(regexp_replace(regexp_extract(r.b, '[^\n]*\z'), '["”’'')\]»]+\z', ''), '[.!?…]{S}*\z') OR regexp_matches(x.p, '^\p{{Ll}}') THEN r.b || ' ' || x.p
        ELSE r.b || chr(10) || chr(10) || x.p END
      FROM run r JOIN parts x ON x.book = r.book AND x.k = r.k + 1)
    SELECT book, arg_max(b, k) AS text FROM run GROUP BY book""",
)
def book_range(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), "text")
    return files.book_ranges(c)


@query("s18_import_check", "SELECT d.doc_id AS n, CASE WHEN d.doc_id <= 0 THEN 'no number' WHEN strlen(text) < 200 THEN 'too short' WHEN l.doc_id IS NOT NULL THEN 'digested already' END AS fault FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def import_check(spark, sf_dir):
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "text")
    return files.importable(inputs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("n"))).select("n", "fault")


@query("s21_segment_inventory", "SELECT CAST(n_regionkey AS VARCHAR) AS chapter, 'e' || n_nationkey % 2 AS engine, count(*) AS files FROM nation GROUP BY ALL")
def segment_inventory(spark, sf_dir):
    path = fresh_path(spark, "segments")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), "n_regionkey").alias("c"), F.concat(F.lit("e"), F.col("n_nationkey") % 2).alias("e"), F.col("n_name").alias("value"), "n_nationkey")
    n.repartition(25, "n_nationkey").drop("n_nationkey").write.partitionBy("c", "e").option("maxRecordsPerFile", 1).text(path)
    found = files.inventory(spark, path).where(F.col("name").startswith("part-"))
    plain = lambda c: F.regexp_replace(c, "^[a-z]=[a-z]?", "")
    return found.groupBy(plain("chapter").alias("chapter"), F.concat(F.lit("e"), plain("engine")).alias("engine")).agg(F.count(F.lit(1)).alias("files"))


@query("s25_ledger_scan", "SELECT o_orderkey AS chapter, CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END AS state, o_orderkey % 9 = 0 AS broken FROM orders".replace("o_orderkey AS chapter", "CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey END AS chapter"))
def ledger_scan(spark, sf_dir):
    """Rows that do not parse are kept word for word."""
    path, k = fresh_path(spark, "ledger"), F.col("o_orderkey")
    good = F.to_json(F.struct(k.alias("chapter"), F.col("o_orderstatus").alias("state")))
    table(spark, sf_dir, "orders").select(F.when(k % 9 == 0, F.concat(F.lit('{"chapter": "x'), k)).otherwise(good).alias("value")).write.text(path)
    return files.ledger(spark, path, "chapter long, state string").select("chapter", "state", F.col("_corrupt").isNotNull().alias("broken"))


@query("s26_ledger_migration", "SELECT o_custkey % 40 AS machine, arg_max(o_orderpriority, o_orderkey) AS config FROM orders WHERE o_custkey % 40 > 0 GROUP BY 1")
def ledger_migration(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("updated"), F.when(F.col("o_custkey") % 40 > 0, F.col("o_custkey") % 40).alias("machine"), F.col("o_orderpriority").alias("config"))
    return files.migrated(old)[1]


@query("s27_index_refresh", "SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 1")
def index_refresh(spark, sf_dir):
    k = F.col("o_orderkey")
    now = table(spark, sf_dir, "orders").select(k.alias("path"), F.when(k % 6 == 1, "changed").otherwise(F.col("o_orderstatus")).alias("stamp"))
    before = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(k.alias("path"), F.col("o_orderstatus").alias("stamp"))
    return files.changed(now, before).select("path")


_STAMP = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


@query("s28_subtitles", f"SELECT conv_id AS chapter, string_agg((turn + 1) || chr(10) || {_STAMP.format('(turn * 61234)')} || ' --> ' || {_STAMP.format('(turn * 61234 + 4000)')} || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS body FROM conversations GROUP BY conv_id")
def subtitles(spark, sf_dir):
    start = F.col("turn") * 61234
    return files.subtitles(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("pos"), start.alias("start"), (start + 4000).alias("end"), "text"))


@query("s29_cue_sheet_round_trip", "SELECT conv_id AS chapter, turn AS i, length(text) AS chars FROM conversations")
def cue_sheet_round_trip(spark, sf_dir):
    path = fresh_path(spark, "cues")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("i"), F.length("text").cast("long").alias("chars"))
    files.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("s33_sound_registry", "SELECT n_name AS name, [lower(n_name)] AS tags, n_nationkey % 2 = 0 AS looped FROM nation")
def sound_registry(spark, sf_dir):
    path = fresh_path(spark, "registry")
    entry = F.struct(F.array(F.lower("n_name")).alias("tags"), (F.col("n_nationkey") % 2 == 0).alias("looped"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("value")).coalesce(1).write.text(path)
    return files.registry(spark, path).select("name", "tags", "looped")


@query("s34_voice_registry", "SELECT r_name AS name, 'v' || r_regionkey || '.wav' AS file, r_regionkey > 2 AS exclusive FROM region")
def voice_registry(spark, sf_dir):
    path = fresh_path(spark, "voices")
    entry = F.struct(F.concat(F.lit("v"), "r_regionkey", F.lit(".wav")).alias("file"), (F.col("r_regionkey") > 2).alias("exclusive"))
    table(spark, sf_dir, "region").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", entry)))).alias("value")).coalesce(1).write.text(path)
    return files.registry(spark, path, files.VOICE).select("name", "file", "exclusive")


@query("s35_scene_rules", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, [lower(n_name)] AS match, CAST(n_regionkey AS DOUBLE) AS level FROM nation")
def scene_rules(spark, sf_dir):
    path = fresh_path(spark, "scenes")
    rule = F.struct("n_nationkey", F.array(F.lower("n_name")).alias("match"), F.col("n_regionkey").cast("double").alias("level"))
    rules = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    rules.select(F.to_json(F.struct("rules")).alias("value")).coalesce(1).write.text(path)
    return files.scene_rules(spark, path).select("pos", "match", "level")


@query("s36_quota_today", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def quota_today(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return files.quota_today(e, "2024-01-05").select("event_id")
