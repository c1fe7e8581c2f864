"""Contracts, packs and script assembly over conversations, customers, parts and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.operators import contracts as op
from taleweave.operators import packs
from taleweave.plans.common import pick, sql_pick, table
from taleweave.registry import query

WHO, KINDS = ("Narrator", "Anna", "Bo", "", "Anonymous", "Cid"), ("narration", "dialogue", "thought")
_LINES = f"lines AS (SELECT conv_id AS chapter, turn AS pos, {sql_pick(WHO, '(conv_id + turn)')} AS speaker, {sql_pick(KINDS, '(turn // 2)')} AS kind, CASE WHEN turn % 4 = 3 THEN ' ' WHEN turn % 3 = 0 THEN 'same' ELSE text END AS text, {sql_pick(('calm', '', 'odd', 'none'), '(conv_id + turn)')} AS music FROM conversations)"
_ROSTER = "roster AS (SELECT DISTINCT conv_id AS chapter, unnest(['Narrator', 'Anna', CASE WHEN conv_id % 2 = 0 THEN 'Bo' ELSE 'Anonymous' END, CASE WHEN conv_id % 5 = 0 THEN 'Dee' ELSE 'Anna' END]) AS name FROM conversations)"


def lines(spark, sf_dir):
    t, k = F.col("turn"), F.col("conv_id") + F.col("turn")
    text = F.when(t % 4 == 3, " ").when(t % 3 == 0, "same").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), t.alias("pos"), pick(WHO, k).alias("speaker"), pick(KINDS, F.floor(t / 2)).alias("kind"), text.alias("text"), pick(("calm", "", "odd", "none"), k).alias("music"))


def roster(spark, sf_dir):
    c = F.col("conv_id")
    names = F.array(F.lit("Narrator"), F.lit("Anna"), F.when(c % 2 == 0, "Bo").otherwise("Anonymous"), F.when(c % 5 == 0, "Dee").otherwise("Anna"))
    return table(spark, sf_dir, "conversations").select(c.alias("chapter"), F.explode(names).alias("name")).distinct()


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


@query("v02_attribution", f"WITH {_LINES}, {_ROSTER} SELECT * FROM (SELECT l.chapter, pos, CASE WHEN trim(speaker) = '' THEN 'dropped' WHEN kind = 'narration' AND speaker <> 'Narrator' THEN 'narration' WHEN kind <> 'narration' AND speaker = 'Narrator' THEN 'speech' WHEN r.name IS NULL THEN 'not listed' END AS fault FROM lines l LEFT JOIN roster r ON r.chapter = l.chapter AND r.name = speaker) WHERE fault IS NOT NULL")
def attribution(spark, sf_dir):
    return op.attribution(lines(spark, sf_dir), roster(spark, sf_dir))


_NEW = "fresh AS (SELECT DISTINCT conv_id AS chapter, CASE WHEN conv_id % 10 = 0 THEN 'Dee' WHEN conv_id % 7 = 0 THEN 'Anonymous' ELSE 'Eve' END AS name FROM conversations)"


@query("v03_identity", f"WITH {_ROSTER}, {_NEW} SELECT chapter, name, 'unknown' AS fault FROM roster WHERE name NOT IN ('Anna', 'Bo', 'Narrator', 'Anonymous') AND (chapter, name) NOT IN (SELECT (chapter, name) FROM fresh) UNION ALL SELECT chapter, name, 'reserved' FROM fresh WHERE name IN ('Narrator', 'Anonymous')")
def identity(spark, sf_dir):
    c = F.col("conv_id")
    new = table(spark, sf_dir, "conversations").select(c.alias("chapter"), F.when(c % 10 == 0, "Dee").when(c % 7 == 0, "Anonymous").otherwise("Eve").alias("name")).distinct()
    return op.identity(roster(spark, sf_dir), names(spark, "Anna", "Bo"), new)


@query("v02_unused_anonymous", f"WITH {_LINES}, {_ROSTER} SELECT chapter, name FROM roster r WHERE name = 'Anonymous' AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.chapter = r.chapter AND l.speaker = r.name)")
def unused_anonymous(spark, sf_dir):
    return op.unused_anonymous(roster(spark, sf_dir), lines(spark, sf_dir))


@query("v04_source_alignment", r"SELECT conv_id, count(*) AS lines, bool_and(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda w: w <> '') = list_filter(regexp_split_to_array(regexp_replace(text, '[.,]', ' ', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS aligned FROM conversations GROUP BY conv_id")
def source_alignment(spark, sf_dir):
    from taleweave.functions.text import words
    from taleweave.operators.script import alignment

    c = table(spark, sf_dir, "conversations").withColumn("a", alignment(words(F.col("text")), words(F.regexp_replace("text", "[.,]", " "))))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lines"), F.bool_and(F.col("a") != "changed").alias("aligned"))


@query("v06_script_contract", f"WITH {_LINES}, g AS (SELECT *, lag(text) OVER w = text AND lag(speaker) OVER w = speaker AS again FROM lines WINDOW w AS (PARTITION BY chapter ORDER BY pos)) SELECT * FROM (SELECT chapter, pos, CASE WHEN trim(text) = '' THEN 'empty' WHEN speaker NOT IN ('Narrator', 'Anna', 'Anonymous') THEN 'unknown speaker' WHEN again THEN 'repeated' END AS fault FROM g) WHERE fault IS NOT NULL")
def script_contract(spark, sf_dir):
    return op.script(lines(spark, sf_dir), names(spark, "Narrator", "Anna", "Anonymous"))


@query("v07_music_palette", f"WITH {_LINES} SELECT * FROM (SELECT chapter, pos, CASE WHEN trim(music) = '' THEN 'missing' WHEN music NOT IN ('calm', 'none') THEN 'not in the palette' END AS fault FROM (SELECT *, bool_or(trim(music) <> '') OVER (PARTITION BY chapter) AS declared FROM lines) WHERE declared) WHERE fault IS NOT NULL")
def music_palette(spark, sf_dir):
    return op.music(lines(spark, sf_dir), ["calm", "none"])


_ITEMS = "items AS (SELECT conv_id AS chapter, turn AS pos, CASE WHEN turn % 4 = 1 THEN 'rain' WHEN turn % 7 = 0 THEN 'gong' END AS sound, CASE WHEN turn % 4 = 3 THEN 'rain' WHEN turn % 8 = 1 THEN 'fire' END AS stop, CASE WHEN turn % 4 IN (0, 2) AND conv_id % 3 > 0 THEN text END AS text FROM conversations)"


@query("v09_inject_contract", f"""WITH {_ITEMS}, b AS (SELECT *, coalesce(bool_or(text IS NOT NULL) OVER (PARTITION BY chapter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS bef, coalesce(sound, stop) AS name FROM items),
    s AS (SELECT *, coalesce(bool_or(sound IS NOT NULL) OVER (PARTITION BY chapter, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS started FROM b)
    SELECT * FROM (SELECT chapter, pos, CASE WHEN sound IS NOT NULL AND stop IS NOT NULL THEN 'two directives' WHEN text IS NOT NULL THEN 'with text' WHEN NOT bef THEN 'nothing before' WHEN name NOT IN ('rain', 'fire') THEN 'unknown sound' WHEN stop IS NOT NULL AND NOT started THEN 'nothing to stop' END AS fault FROM s WHERE name IS NOT NULL) WHERE fault IS NOT NULL""")
def inject_contract(spark, sf_dir):
    t = F.col("turn")
    items = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chapter"), t.alias("pos"), F.when(t % 4 == 1, "rain").when(t % 7 == 0, "gong").alias("sound"),
        F.when(t % 4 == 3, "rain").when(t % 8 == 1, "fire").alias("stop"), F.when((t % 4).isin(0, 2) & (F.col("conv_id") % 3 > 0), F.col("text")).alias("text"),
    )
    return op.injects(items, names(spark, "rain", "fire"))


@query("v11_context_contract", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'no name' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'voice head' WHEN n_regionkey IS NULL OR c_custkey % 6 = 0 THEN 'tag' END AS fault FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 11 = 0 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') OR n_regionkey IS NULL OR c_custkey % 6 = 0")
def context_contract(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c, key = table(spark, sf_dir, "customer").join(n, "c_nationkey", "left"), F.col("c_custkey")
    fault = F.when(key % 11 == 0, "no name").when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "voice head").when(F.col("n_regionkey").isNull() | (key % 6 == 0), "tag")
    return c.select("c_custkey", fault.alias("fault")).where("fault is not null")


@query("v16_binding_check", "SELECT a.o_orderkey, a.o_orderpriority AS bound, b.o_orderpriority AS found FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey % 2 = 0 AND a.o_orderpriority <> b.o_orderpriority")
def binding_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    found = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderpriority").alias("found"))
    return o.where("o_custkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("bound")).join(found, "o_orderkey").where("bound <> found")


@query("v17_adapter_verdict", "SELECT c_custkey, CASE WHEN declared = '' THEN 'undeclared' WHEN lower(declared) <> lower(pack) THEN 'mismatch' WHEN c_nationkey % 4 = 0 THEN 'cannot voice' ELSE 'agrees' END AS verdict FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE 'Building' END AS declared, c_mktsegment AS pack FROM customer)")
def adapter_verdict(spark, sf_dir):
    key = F.col("c_custkey")
    declared = F.when(key % 5 == 0, "").when(key % 3 == 0, F.upper("c_mktsegment")).otherwise("Building")
    verdict = F.when(declared == "", "undeclared").when(F.lower(declared) != F.lower("c_mktsegment"), "mismatch").when(F.col("c_nationkey") % 4 == 0, "cannot voice").otherwise("agrees")
    return table(spark, sf_dir, "customer").select("c_custkey", verdict.alias("verdict"))


@query("v18_retag_preflight", r"SELECT conv_id, count(*) FILTER (role <> 'system' AND regexp_matches(text, '(?i)\b(?:et|de) ')) AS edits FROM conversations GROUP BY conv_id")
def retag_preflight(spark, sf_dir):
    hit = (F.col("role") != "system") & F.col("text").rlike(r"(?i)\b(?:et|de) ")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(hit).alias("edits"))


@query("v12_sound_gap", f"WITH {_ITEMS} SELECT chapter, CASE WHEN count(*) FILTER (sound = 'rain') > count(*) FILTER (stop = 'rain') THEN 'unclosed' WHEN count(*) FILTER (sound = 'gong') > 1 THEN 'overlong' WHEN count(sound) = 0 THEN 'silent' END AS gap FROM items GROUP BY chapter")
def sound_gap(spark, sf_dir):
    t = F.col("turn")
    sound, stop = F.when(t % 4 == 1, "rain").when(t % 7 == 0, "gong"), F.when(t % 4 == 3, "rain").when(t % 8 == 1, "fire")
    n = lambda c: F.count_if(c)
    gap = F.when(n(sound == "rain") > n(stop == "rain"), "unclosed").when(n(sound == "gong") > 1, "overlong").when(F.count(sound) == 0, "silent")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("chapter")).agg(gap.alias("gap"))


# ---- script assembly -----------------------------------------------------------------------------------------------


@query("f37_seam_expansion", "SELECT conv_id, turn, CAST(k AS INTEGER) AS k, item FROM (SELECT conv_id, turn, unnest(range(len(i))) AS k, unnest(i) AS item FROM (SELECT conv_id, turn, list_filter(['line:' || role, CASE WHEN turn % 2 = 0 THEN 'sound:door' END, CASE WHEN turn % 3 = 0 THEN 'stop:rain' END], lambda x: x IS NOT NULL) AS i FROM conversations))")
def seam_expansion(spark, sf_dir):
    t = F.col("turn")
    items = F.array_compact(F.array(F.concat(F.lit("line:"), "role"), F.when(t % 2 == 0, "sound:door"), F.when(t % 3 == 0, "stop:rain")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(items).alias("k", "item"))


@query("f38_field_accessors", "SELECT event_id, trim(json_extract_string(props, '$.k')) AS k, coalesce(json_extract_string(props, '$.tags'), event_type) AS tags FROM events")
def field_accessors(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.trim(F.get_json_object("props", "$.k")).alias("k"), F.coalesce(F.get_json_object("props", "$.tags"), "event_type").alias("tags"))


@query("f39_merge_rounds", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'script' ELSE 'context' END AS title_from, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, n_name) AS title FROM customer JOIN nation ON n_nationkey = c_nationkey")
def merge_rounds(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    own = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey").select("c_custkey", F.when(own.isNotNull(), "script").otherwise("context").alias("title_from"), F.coalesce(own, "n_name").alias("title"))


@query("f40_speaker_map", """SELECT conv_id, list_sort(list('e' || lpad(CAST(turn + 1 AS VARCHAR), 4, '0') || '=' || role)) AS speakers FROM conversations GROUP BY conv_id""")
def speaker_map(spark, sf_dir):
    entry = F.concat(F.lit("e"), F.lpad((F.col("turn") + 1).cast("string"), 4, "0"), F.lit("="), "role")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("speakers"))


@query("f41_attach_speakers", "SELECT a.conv_id, a.turn, coalesce(b.role, 'Narrator') AS speaker FROM conversations a LEFT JOIN (SELECT conv_id, turn, role FROM conversations WHERE turn % 3 > 0) b USING (conv_id, turn)")
def attach_speakers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    fixed = c.where("turn % 3 > 0").select("conv_id", "turn", "role")
    return c.select("conv_id", "turn").join(fixed, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("role", F.lit("Narrator")).alias("speaker"))


@query("f42_plan_utterances", "WITH l AS (SELECT *, sum(CASE WHEN turn % 4 <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS line FROM conversations) SELECT conv_id, CAST(line AS BIGINT) AS line, string_agg(CASE WHEN turn % 4 <> 2 THEN role END, '' ORDER BY turn) AS speaker, count(*) FILTER (turn % 4 = 2) AS sounds FROM l WHERE line > 0 GROUP BY conv_id, line")
def plan_utterances(spark, sf_dir):
    spoken = F.col("turn") % 4 != 2
    so_far = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    l = table(spark, sf_dir, "conversations").withColumn("line", F.sum(F.when(spoken, 1).otherwise(0)).over(so_far)).where("line > 0")
    return l.groupBy("conv_id", "line").agg(F.max(F.when(spoken, F.col("role"))).alias("speaker"), F.count_if(~spoken).alias("sounds"))


@query("f44_nonverbal_resolve", "SELECT event_id, CASE event_type WHEN 'view' THEN '[sigh]' WHEN 'click' THEN '[laugh]' END AS tag FROM events")
def nonverbal_resolve(spark, sf_dir):
    tags = F.create_map(*[F.lit(x) for x in ("view", "[sigh]", "click", "[laugh]")])
    return table(spark, sf_dir, "events").select("event_id", tags[F.col("event_type")].alias("tag"))


@query("f14_caption_text", rf"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text || ' -- end', '[ ]*(?:-{{2,}}|[–—]+)[ ]*', '; ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS text FROM conversations")
def caption_text(spark, sf_dir):
    from taleweave.functions.markup import squeeze

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", squeeze(F.regexp_replace(F.concat("text", F.lit(" -- end")), "[ ]*(?:-{2,}|[–—]+)[ ]*", "; ")).alias("text"))


@query("j27_carry_source_text", "SELECT c.conv_id, c.turn, CASE WHEN c.turn % 3 = 0 THEN s.text ELSE 'own' END AS text FROM conversations c LEFT JOIN conversations s ON s.conv_id = c.conv_id AND s.turn = c.turn - 1")
def carry_source_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    source = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    own = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, " ").otherwise("own").alias("text"))
    return own.join(source, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "source").alias("text"))


@query("j28_stale_design", "SELECT a.o_orderkey, a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS stale FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 2 WHERE a.o_orderstatus = 'F'")
def stale_design(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = o.select((F.col("o_orderkey") - 2).alias("o_orderkey"), F.col("o_orderpriority").alias("now"))
    met = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority").join(now, "o_orderkey", "left")
    return met.select("o_orderkey", (~F.col("o_orderpriority").eqNullSafe(F.col("now"))).alias("stale"))


@query("j29_gender_contradictions", "SELECT c_custkey, n_nationkey % 2 AS voice, c_custkey % 2 AS stated FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 <> c_custkey % 2 AND c_mktsegment <> 'BUILDING'")
def gender_contradictions(spark, sf_dir):
    voices = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 2).alias("voice"))
    cast = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 2).alias("stated"))
    return cast.join(voices, "c_nationkey").where("voice <> stated").select("c_custkey", "voice", "stated")


@query("j30_beat_backed", "WITH b AS (SELECT user_id % 40 AS addr, max(event_id) AS beat FROM events GROUP BY 1), m AS (SELECT s_suppkey AS addr, s_nationkey % 5 = 0 AS offline, s_nationkey * 380 AS since FROM supplier) SELECT b.addr, m.addr IS NULL OR NOT offline OR beat >= since AS backed FROM b LEFT JOIN m USING (addr)")
def beat_backed(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("addr")).agg(F.max("event_id").alias("beat"))
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("addr"), (F.col("s_nationkey") % 5 == 0).alias("offline"), (F.col("s_nationkey") * 380).alias("since"))
    met = b.join(m, "addr", "left")
    return met.select("addr", (F.col("offline").isNull() | ~F.col("offline") | (F.col("beat") >= F.col("since"))).alias("backed"))


@query("j31_portraits", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE coalesce(n_name, 'fallback') END AS portrait FROM conversations LEFT JOIN nation ON lower(n_name) = lower('NATION_' || turn) AND role <> 'system'")
def portraits(spark, sf_dir):
    art = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"), "n_name")
    c = table(spark, sf_dir, "conversations").withColumn("key", F.lower(F.concat(F.lit("NATION_"), "turn")))
    return c.join(art, "key", "left").select("conv_id", "turn", F.when(F.col("role") != "system", F.coalesce("n_name", F.lit("fallback"))).alias("portrait"))


@query("j33_relink", "WITH live AS (SELECT s_suppkey AS id, s_nationkey AS addr FROM supplier WHERE s_suppkey % 3 > 0), kept AS (SELECT c_custkey AS id, c_nationkey AS addr FROM customer) SELECT k.id, k.addr AS old, live.addr AS new FROM kept k JOIN live USING (id) WHERE k.addr <> live.addr")
def relink(spark, sf_dir):
    live = table(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("new"))
    kept = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("old"))
    return kept.join(live, "id").where("old <> new").select("id", "old", "new")


@query("j20_cast_view", "WITH c AS (SELECT c_custkey, c_name, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) - 1 AS shared FROM customer) SELECT c_name, n_name AS voice, shared, CASE WHEN c_custkey = 0 THEN 0 ELSE 1 END AS place FROM c LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 4 > 0")
def cast_view(spark, sf_dir):
    voices = table(spark, sf_dir, "nation").where("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("voice"))
    c = table(spark, sf_dir, "customer")
    users = c.groupBy("c_nationkey").agg((F.count(F.lit(1)) - 1).alias("shared"))
    return c.join(users, "c_nationkey").join(voices, "c_nationkey", "left").select("c_name", "voice", "shared", F.when(F.col("c_custkey") == 0, 0).otherwise(1).alias("place"))


# ---- packs ---------------------------------------------------------------------------------------------------------

_DEPS = "deps AS (SELECT 'p' || n_nationkey AS name, 'p' || (n_nationkey * 2 + 1) AS dep FROM nation WHERE n_nationkey * 2 + 1 < 25 UNION SELECT 'p' || n_nationkey, 'p' || (n_nationkey * 3 + 2) FROM nation WHERE n_nationkey * 3 + 2 < 25)"


def deps(spark, sf_dir):
    n = F.col("n_nationkey")
    d = lambda e: table(spark, sf_dir, "nation").where(e < 25).select(F.concat(F.lit("p"), n).alias("name"), F.concat(F.lit("p"), e).alias("dep"))
    return d(n * 2 + 1).union(d(n * 3 + 2)).distinct()


@query("u08_closure", f"WITH RECURSIVE {_DEPS}, r(name, depth) AS (SELECT dep, 1 FROM deps WHERE name = 'p0' UNION SELECT d.dep, r.depth + 1 FROM r JOIN deps d ON d.name = r.name) SELECT name, max(depth) AS depth, name IN (SELECT dep FROM deps WHERE name = 'p0') AS direct FROM r GROUP BY name")
def closure(spark, sf_dir):
    return packs.closure(deps(spark, sf_dir), "p0")


_ENTRIES = f"entries AS (SELECT p_brand AS pack, p_type AS member, 'k' || p_size AS key, min(p_name) AS value, {sql_pick(('whole', 'key', 'list'), 'length(p_type)')} AS mode FROM part GROUP BY ALL), strength AS (SELECT DISTINCT p_brand AS pack, CAST(substr(p_brand, 7) AS INTEGER) AS rank FROM part)"


@query("u09_layered_merge", f"WITH {_ENTRIES}, e AS (SELECT * FROM entries JOIN strength USING (pack)) SELECT member, key, value FROM (SELECT *, max(rank) OVER (PARTITION BY member) AS top FROM e) WHERE mode = 'whole' AND rank = top UNION ALL SELECT member, key, arg_max(value, rank) FROM e WHERE mode = 'key' GROUP BY member, key UNION ALL SELECT member, '', string_agg(value, ',' ORDER BY rank DESC, key, value) FROM e WHERE mode = 'list' GROUP BY member")
def layered_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    entries = p.groupBy(F.col("p_brand").alias("pack"), F.col("p_type").alias("member"), F.concat(F.lit("k"), "p_size").alias("key"), pick(("whole", "key", "list"), F.length("p_type")).alias("mode")).agg(F.min("p_name").alias("value"))
    strength = p.select(F.col("p_brand").alias("pack"), F.substring("p_brand", 7, 9).cast("int").alias("rank")).distinct()
    return packs.layered(entries, strength)


_WITHDRAW = "WITH live AS (SELECT p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 5 > 0), rec AS (SELECT p_partkey AS key, sha256(CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_name END) AS hash FROM part WHERE p_partkey % 3 > 0), w AS (SELECT key, CASE WHEN hash IS NULL THEN 'own' WHEN value IS NULL THEN 'gone' WHEN sha256(value) = hash THEN 'withdrawn' ELSE 'adopted' END AS action FROM live FULL JOIN rec USING (key))"


def withdrawn(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    recorded = p.where("p_partkey % 3 > 0").select(key.alias("key"), F.sha2(F.when(key % 7 == 0, "x").otherwise(F.col("p_name")), 256).alias("hash"))
    return packs.withdraw(p.where("p_partkey % 5 > 0").select(key.alias("key"), F.col("p_name").alias("value")), recorded)


@query("u10_withdraw", f"{_WITHDRAW} SELECT key, action FROM w")
def withdraw(spark, sf_dir):
    return withdrawn(spark, sf_dir)


@query("u11_resolve_report", f"{_WITHDRAW} SELECT action, count(*) AS n FROM w GROUP BY action")
def resolve_report(spark, sf_dir):
    return withdrawn(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_STEPS = "steps AS (SELECT 'n' || n_nationkey AS old, 'n' || (n_nationkey + 7) AS new FROM nation)"


def steps(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n).alias("old"), F.concat(F.lit("n"), n + 7).alias("new"))


_CHAINS = f"WITH RECURSIVE {_STEPS}, c(old, new) AS (SELECT old, new FROM steps UNION SELECT c.old, s.new FROM c JOIN steps s ON s.old = c.new), ends AS (SELECT old, new FROM c WHERE new NOT IN (SELECT old FROM steps))"


@query("u12_rename_history", f"{_CHAINS} SELECT old, new FROM ends")
def rename_history(spark, sf_dir):
    return packs.renames(steps(spark, sf_dir))


@query("u12_rename_outcome", f"{_CHAINS}, have AS (SELECT 'n' || n_nationkey AS name FROM nation WHERE n_nationkey % 3 > 0) SELECT old, new, CASE WHEN new IN (SELECT name FROM have) THEN 'keep' WHEN old IN (SELECT name FROM have) THEN 'apply' ELSE 'missing' END AS outcome FROM ends")
def rename_outcome(spark, sf_dir):
    have = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))
    return packs.applied(have, packs.renames(steps(spark, sf_dir)))


@query("u13_pack_updates", "SELECT p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'drift' WHEN p_size % 2 = 0 THEN 'up to date' ELSE 'update' END AS plan FROM part")
def pack_updates(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    wanted = p.select(key.alias("name"), F.sha2("p_name", 256).alias("hash"))
    was = F.sha2(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "").otherwise("-")), 256)
    installed = p.where("p_partkey % 5 > 0").select(key.alias("name"), was.alias("hash"), F.when(key % 7 == 0, "edited").otherwise(was).alias("live"))
    return packs.updates(wanted, installed)


@query("u02_ordered_union", "SELECT conv_id, list_distinct(list_concat(['user', 'Narrator'], list(role ORDER BY turn)))[1:0] AS none, len(list_distinct(list_concat(['user', 'Narrator'], list(role)))) AS n FROM conversations GROUP BY conv_id")
def ordered_union(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    u = F.array_union(F.array(F.lit("user"), F.lit("Narrator")), roles)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.slice(u, 1, 0).alias("none"), F.size(u).cast("long").alias("n"))


@query("t20_pool_leases", """WITH there AS (SELECT DISTINCT l_suppkey AS pool, l_partkey // 3 AS pos FROM lineitem), size AS (SELECT pool, max(pos) AS most FROM there GROUP BY pool),
    gone AS (SELECT pool, pos FROM (SELECT pool, unnest(range(most + 1)) AS pos FROM size) ANTI JOIN there USING (pool, pos)), r AS (SELECT pool, pos, pos - row_number() OVER (PARTITION BY pool ORDER BY pos) AS run FROM gone)
    SELECT pool, min(pos) AS "from", count(*) AS count FROM r GROUP BY pool, run""")
def pool_leases(spark, sf_dir):
    """The runs of each pool up to its last chunk that is home that are missing."""
    from taleweave.operators.timeline import gaps

    there = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chapter"), F.floor(F.col("l_partkey") / 3).alias("pos"))
    return gaps(there).select(F.col("chapter").alias("pool"), "from", "count")
