"""Greedy and stateful operators over chapters, with SQL where recursion or windows can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleweave.functions import bits
from taleweave.functions import text as tx
from taleweave.operators import sequential as op
from taleweave.operators import timeline as tl
from taleweave.plans.common import S, pick, sql_pick, sql_trim, table
from taleweave.plans.timeline import _SLOTS, _islands, lines, slots
from taleweave.registry import query

_COST = rf"cost AS (SELECT conv_id AS chapter, turn AS pos, CAST(length(text) + 64 AS BIGINT) AS w, CAST(len(regexp_extract_all(text, '[.!?…]')) AS BIGINT) AS s, regexp_matches(text, '[.!?…][\"”’'')\]»]*{S}*\z') AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"
_CLOSE = "((s >= 6 AND e) OR (c >= 900 AND (e OR c >= 1350)))"


@query(
    "w10_digest_windows",
    f"""WITH RECURSIVE {_COST}, run AS (
      SELECT chapter, pos, k, 0 AS win, w AS c, s, CAST(1 AS BIGINT) AS n, e FROM cost WHERE k = 1
      UNION ALL SELECT x.chapter, x.pos, x.k, CASE WHEN {_CLOSE.replace('(s ', '(r.s ').replace('c >=', 'r.c >=').replace('AND e)', 'AND r.e)').replace('(e OR', '(r.e OR')} THEN r.win + 1 ELSE r.win END,
        CASE WHEN {_CLOSE.replace('(s ', '(r.s ').replace('c >=', 'r.c >=').replace('AND e)', 'AND r.e)').replace('(e OR', '(r.e OR')} THEN x.w ELSE r.c + x.w END,
        CASE WHEN {_CLOSE.replace('(s ', '(r.s ').replace('c >=', 'r.c >=').replace('AND e)', 'AND r.e)').replace('(e OR', '(r.e OR')} THEN x.s ELSE r.s + x.s END,
        CASE WHEN {_CLOSE.replace('(s ', '(r.s ').replace('c >=', 'r.c >=').replace('AND e)', 'AND r.e)').replace('(e OR', '(r.e OR')} THEN 1 ELSE r.n + 1 END, x.e
      FROM run r JOIN cost x ON x.chapter = r.chapter AND x.k = r.k + 1)
    SELECT chapter, win AS "window", max(pos) AS "to", max(n) AS lines, max(c) AS chars, max(s) AS sentences FROM run GROUP BY chapter, win""",
)
def digest_windows(spark, sf_dir):
    return op.batches(lines(spark, sf_dir), 6, 900)


@query("w06_effect_windows")
def effect_windows(spark, sf_dir):
    own = slots(spark, sf_dir).withColumn("on", F.col("scene").isin("cave", "hall"))
    return op.effect_windows(own, 0.3, 1500, 9000, 2000)


_DIR = f"""{_SLOTS}, dir AS (SELECT chapter, pos, k, "end", CASE (pos + k) % 3 WHEN 0 THEN 'door' WHEN 1 THEN 'bell' ELSE 'rain' END AS sound, 300 * (k + 1) AS dur, CASE WHEN k = 0 THEN 300 ELSE 0 END AS advance, (pos + k) % 3 = 2 AS looped, pos % 5 = 4 AS stop FROM slots, range(2) r(k)),
  placed AS (SELECT *, "end" + coalesce(sum(advance) OVER (PARTITION BY chapter, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM dir),
  nexts AS (SELECT *, lead(began) OVER (PARTITION BY chapter, sound ORDER BY pos, k) AS aft FROM placed)"""


_ENDS = "CASE WHEN looped THEN coalesce(aft, began + dur) ELSE least(began + dur, coalesce(aft, began + dur)) END"


@query("w09_inject_events", f"""WITH {_DIR} SELECT chapter, pos, k, sound, CAST(began AS BIGINT) AS "from", CAST({_ENDS} AS BIGINT) AS "to" FROM nexts WHERE NOT stop AND {_ENDS} > began""")
def inject_events(spark, sf_dir):
    k = slots(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    which = (F.col("pos") + F.col("k")) % 3
    d = k.select("chapter", "pos", "k", "end", F.when(which == 0, "door").when(which == 1, "bell").otherwise("rain").alias("sound"), (300 * (F.col("k") + 1)).alias("dur"), F.when(F.col("k") == 0, 300).otherwise(0).alias("advance"), (which == 2).alias("looped"), (F.col("pos") % 5 == 4).alias("stop"))
    return op.inject_events(d)


@query("w26_release_hold", "SELECT user_id, event_id, round(exp(max(ln(value) - pos * ln(0.9)) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) + pos * ln(0.9)), 6) AS hold FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)")
def release_hold(spark, sf_dir):
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chapter"), pos.alias("pos"), F.col("value").alias("x"), "event_id")
    return op.release_hold(e, 0.9).select(F.col("chapter").alias("user_id"), "event_id", (F.round(F.col("hold") * 1e6) / 1e6).alias("hold"))


@query("w29_keyframes")
def keyframes(spark, sf_dir):
    series = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chapter"), F.transform("embedding", lambda y, i: F.struct(i.cast("long").alias("pos"), y.cast("double").alias("y"))).alias("items"))
    return op.decimate(series, 0.05)


@query("f01_quote_segmentation")
def quote_segmentation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter"), "text")
    return op.quote_events(d)


@query(
    "f01_quote_parity",
    """SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos % 2 = 1 THEN 'dialogue' ELSE 'narration' END AS kind, part FROM (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS part FROM (SELECT doc_id, string_split(text, '"') AS p FROM documents)) WHERE trim(part) <> ''""",
)
def quote_parity(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", '"', -1)).alias("pos", "part"))
    return p.where(F.trim("part") != "").select("doc_id", "pos", F.when(F.col("pos") % 2 == 1, "dialogue").otherwise("narration").alias("kind"), "part")


_SENT = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_trim('x')}), lambda x: x <> '')"


@query(
    "f02_thought_carving",
    rf"""WITH s AS (SELECT conv_id, turn, CAST(unnest(range(len(p))) AS INTEGER) AS k, unnest(p) AS sentence FROM (SELECT conv_id, turn, {_SENT} AS p FROM conversations)),
    f AS (SELECT *, regexp_matches(lower(sentence), '^(?:un|the|et)[^\p{{L}}]') AS marked FROM s), n AS (SELECT *, count(*) OVER w AS total, count(*) FILTER (marked) OVER w AS m FROM f WINDOW w AS (PARTITION BY conv_id))
    SELECT conv_id, turn, k, CASE WHEN marked AND NOT (m >= 3 AND m * 5 >= total) THEN 'thought' ELSE 'narration' END AS kind FROM n""",
)
def thought_carving(spark, sf_dir):
    """Sentences of a marked kind, unless there are so many of them that the chapter itself is told that way."""
    from pyspark.sql import Window as W

    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("k", "sentence"))
    w = W.partitionBy("conv_id")
    f = s.withColumn("marked", F.lower("sentence").rlike(r"^(?:un|the|et)[^\p{L}]")).withColumns({"total": F.count(F.lit(1)).over(w), "m": F.count_if("marked").over(w)})
    voiced = (F.col("m") >= 3) & (F.col("m") * 5 >= F.col("total"))
    return f.select("conv_id", "turn", "k", F.when(F.col("marked") & ~voiced, "thought").otherwise("narration").alias("kind"))


def _packed(keys: str, parts: str, most: int, number: str) -> str:
    """SQL that packs parts (keys, k from 1, p) greedily into chunks of `most` characters, with the same slack for a tail."""
    slack = min(15, most // 8)
    size = "length(r.b) + 1 + length(x.p)"
    fits = f"({size} <= {most} OR (length(x.p) <= {slack} AND {size} <= {most + slack}))"
    met = " AND ".join(f"x.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""WITH RECURSIVE parts AS ({parts}), run AS (
      SELECT {keys}, k, p AS b, 0 AS n FROM parts WHERE k = 1
      UNION ALL SELECT {own}, x.k, CASE WHEN {fits} THEN r.b || ' ' || x.p ELSE x.p END, CASE WHEN {fits} THEN r.n ELSE r.n + 1 END FROM run r JOIN parts x ON {met} AND x.k = r.k + 1)
    SELECT {keys}, n AS {number}, arg_max(b, k) AS text FROM run GROUP BY {keys}, n"""


_SENTENCES = rf"SELECT doc_id, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS s FROM documents)"


@query("f06_chunk_packing", _packed("doc_id", _SENTENCES, 200, "chunk"))
def chunk_packing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(op.packed(tx.sentences(F.col("text")), 200)).alias("chunk", "text"))


_TURN_WORDS = rf"SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS p FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS s FROM conversations)"


@query("f07_long_part_split", _packed("conv_id, turn", _TURN_WORDS, 80, "piece"))
def long_part_split(spark, sf_dir):
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(op.packed(words, 80)).alias("piece", "text"))


@query("f12_sentence_chunks", rf"""WITH p AS (SELECT doc_id, unnest(range(len(l))) AS par, unnest(l) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\n') AS l FROM documents)), s AS (SELECT doc_id, par, unnest(range(len(x))) AS k, unnest(x) AS chunk FROM (SELECT doc_id, par, {_SENT} AS x FROM p)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY par, k) AS place FROM s) SELECT doc_id, place, chunk, CASE WHEN place = 1 THEN NULL WHEN k = 0 THEN 'para' ELSE 'sentence' END AS gap FROM o""")
def sentence_chunks(spark, sf_dir):
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("par", "text"))
    s = p.select("doc_id", "par", F.posexplode(tx.sentences(F.col("text"))).alias("k", "chunk"))
    o = s.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("par", "k")).cast("long"))
    return o.select("doc_id", "place", "chunk", F.when(F.col("place") == 1, None).when(F.col("k") == 0, "para").otherwise("sentence").alias("gap"))


@query("f58_fnv_seed", f"""SELECT c_custkey, CAST(list_reduce(list_prepend({bits.FNV_START}::UHUGEINT, list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda h: CAST(CAST('0x' || h AS INTEGER) AS UHUGEINT))), lambda h, b: (xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT))::UHUGEINT * {bits.FNV_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS seed FROM customer""")
def fnv_seed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", bits.fnv1a(F.col("c_name")).cast("string").alias("seed"))


def _sql_split_mix(state: str) -> str:
    """SplitMix64 in unsigned 128-bit integers: a product of two 64-bit numbers fits."""
    wrap = "18446744073709551616::UHUGEINT"
    z = f"(({state})::UHUGEINT + {bits.MIX_STEP}::UHUGEINT) % {wrap}"
    for shift, factor in ((30, bits.MIX_1), (27, bits.MIX_2)):
        z = f"list_transform([{z}], lambda z: (xor(z, z // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {wrap})[1]"
    return f"list_transform([{z}], lambda z: xor(z, z // {1 << 31}::UHUGEINT))[1]"


@query("f57_split_mix", f"SELECT c_custkey, CAST({_sql_split_mix('c_custkey')} AS VARCHAR) AS draw FROM customer")
def split_mix(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", bits.split_mix(F.col("c_custkey").cast("decimal(38,0)")).cast("string").alias("draw"))


@query("f29_syllables", r"SELECT doc_id, list_sum(list_transform(w, lambda t: greatest(len(regexp_extract_all(t, '[aeiouyæɐɑɒɔəɘɛɜɤɯɵøœʉʊʌɪɨ]+')), 1))) AS syllables FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '<\|emotion_[0-9]+\|>|</?en>', '', 'g'), '[^\p{L}]+'), lambda t: t <> '') AS w FROM documents) WHERE len(w) > 0")
def syllables(spark, sf_dir):
    w = F.filter(F.split(tx.strip_cues(F.lower("text")), r"[^\p{L}]+"), lambda t: t != "")
    count = F.aggregate(F.transform("w", lambda t: F.greatest(F.regexp_count(t, F.lit("[aeiouyæɐɑɒɔəɘɛɜɤɯɵøœʉʊʌɪɨ]+")), F.lit(1)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where(F.size("w") > 0).select("doc_id", count.alias("syllables"))


_PATHS = ("a%20b/c.html", "x+y%2Fz", "%E1%BA%A1.txt", "plain")


@query("f31_percent_decode", f"SELECT doc_id, url_decode(replace(p, '+', '%2B')) AS path FROM (SELECT doc_id, {sql_pick(_PATHS, 'doc_id')} AS p FROM documents)")
def percent_decode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.url_decode(F.replace(pick(_PATHS, F.col("doc_id")), F.lit("+"), F.lit("%2B"))).alias("path"))


_LAUGH = ("ha ha ha, well", "He said haha.", "hm, ho ho!", "what a day")


@query("f23_retag_sounds", f"SELECT doc_id, regexp_replace(t, '(?i)\\b(?:ha|ho)(?:[ -]?(?:ha|ho))+\\b', '[laugh]', 'g') AS text FROM (SELECT doc_id, {sql_pick(_LAUGH, 'doc_id')} AS t FROM documents)")
def retag_sounds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(pick(_LAUGH, F.col("doc_id")), r"(?i)\b(?:ha|ho)(?:[ -]?(?:ha|ho))+\b", "[laugh]").alias("text"))


@query("o05_least_used_voice", """WITH sp AS (SELECT conv_id AS chapter, turn AS pos, role || turn AS speaker, turn % 2 AS gender FROM conversations), v AS (SELECT n_nationkey AS voice, n_nationkey % 2 AS gender, n_regionkey AS used, n_nationkey AS place FROM nation),
    r AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY used, place) - 1 AS t, count(*) OVER (PARTITION BY gender) AS n FROM v), a AS (SELECT *, row_number() OVER (PARTITION BY chapter, gender ORDER BY pos) - 1 AS k FROM sp)
    SELECT a.chapter, a.pos, a.speaker, r.voice FROM a JOIN r ON r.gender = a.gender AND r.t = a.k % r.n""")
def least_used_voice(spark, sf_dir):
    t, n = F.col("turn"), F.col("n_nationkey")
    sp = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), t.alias("pos"), F.concat("role", t).alias("speaker"), (t % 2).alias("gender"))
    v = table(spark, sf_dir, "nation").select(n.alias("voice"), (n % 2).cast("long").alias("gender"), F.col("n_regionkey").alias("used"), n.alias("place"))
    return op.assign_voices(sp, v)


@query("w19_cap_overlong_beds", f"""WITH {_SLOTS}, {_islands('slots', 'scene')}, sp AS (SELECT chapter, CAST(island AS BIGINT) AS island, min(pos) AS first, count(*) AS n FROM isl GROUP BY ALL), t AS (SELECT chapter, greatest(CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT), 1) AS most FROM slots GROUP BY chapter)
    SELECT chapter, island, first + least(n, most) - 1 AS stop FROM sp JOIN t USING (chapter)""")
def cap_overlong_beds(spark, sf_dir):
    own = slots(spark, sf_dir)
    sp = tl.islands(own, ["scene"]).groupBy("chapter", "island").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    most = own.groupBy("chapter").agg(F.greatest(F.ceil(F.count(F.lit(1)) * 0.2), F.lit(1)).alias("most"))
    return sp.join(most, "chapter").select("chapter", "island", (F.col("first") + F.least("n", "most") - 1).alias("stop"))
