"""Turns of conversations as lines of a chapter, laid out on a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.operators import timeline as op
from taleweave.plans.common import pick, sql_pick, table
from taleweave.registry import query

SCENES, MUSIC = ("cave", "road", "", "hall", "cave"), ("calm", "", "none", "tense", "calm")
_SLOTS = f"""slots0 AS (SELECT conv_id AS chapter, turn AS pos, role AS speaker, text, length(text) * 40 AS dur, 250 AS gap,
    CASE WHEN turn % 3 = 0 THEN 400 + 10 * (turn % 4) ELSE 0 END AS pause, {sql_pick(SCENES, '(conv_id + turn // 2)')} AS scene, {sql_pick(MUSIC, '(conv_id + turn // 3)')} AS music
  FROM conversations),
  slots AS (SELECT *, start + dur AS "end" FROM (SELECT *, CAST(coalesce(sum(dur + gap + pause) OVER (PARTITION BY chapter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM slots0))"""
_WIN = "(PARTITION BY chapter ORDER BY pos)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, half = F.col("turn"), F.floor(F.col("turn") / 2)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chapter"), turn.alias("pos"), F.col("role").alias("speaker"), "text", (F.length("text") * 40).cast("long").alias("dur"), F.lit(250).cast("long").alias("gap"),
        F.when(turn % 3 == 0, 400 + 10 * (turn % 4)).otherwise(0).cast("long").alias("pause"),
        pick(SCENES, F.col("conv_id") + half).alias("scene"), pick(MUSIC, F.col("conv_id") + F.floor(turn / 3)).alias("music"),
    )


def slots(spark, sf_dir):
    return op.layout(lines(spark, sf_dir))


@query("w01_layout", f'WITH {_SLOTS} SELECT chapter, pos, start, "end" FROM slots')
def layout(spark, sf_dir):
    return slots(spark, sf_dir).select("chapter", "pos", "start", "end")


@query("w02_retime", f"""WITH {_SLOTS} SELECT chapter, pos, CAST(round(start / 1.25::DOUBLE) AS BIGINT) AS start, CAST(round("end" / 1.25::DOUBLE) AS BIGINT) AS "end", CAST(round(gap / 1.25::DOUBLE) AS BIGINT) AS gap, CAST(round(pause / 1.25::DOUBLE) AS BIGINT) AS pause FROM slots""")
def retime(spark, sf_dir):
    return op.retime(slots(spark, sf_dir), 1.25).select("chapter", "pos", "start", "end", "gap", "pause")


@query("w03_pause_intervals", f"""WITH {_SLOTS} SELECT chapter, pos, "end" AS "from", "end" + pause AS "to" FROM slots WHERE pause > 0""")
def pause_intervals(spark, sf_dir):
    return op.pause_intervals(slots(spark, sf_dir))


@query("w03_headline_end", f"""WITH {_SLOTS} SELECT chapter, "end" AS headline_end FROM (SELECT *, row_number() OVER {_WIN} AS k FROM slots) WHERE k = 1 AND "end" > 0 AND scene = '' AND music = ''""")
def headline_end(spark, sf_dir):
    return op.headline_end(slots(spark, sf_dir))


@query(
    "w04_beats",
    f"""WITH {_SLOTS}, both_ AS (SELECT *, lag(scene) OVER {_WIN} AS b, lag(speaker) OVER {_WIN} AS sb FROM slots),
    c AS (SELECT chapter, pos, CASE WHEN speaker = 'assistant' THEN 2 ELSE 1 END AS rank, pause FROM both_ WHERE b <> '' AND scene <> '' AND b <> scene AND (speaker = 'assistant' OR sb = 'assistant'))
    SELECT chapter, pos, rank, pause FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY rank DESC, pause DESC, pos) AS k FROM c) WHERE k <= 2""",
)
def beats(spark, sf_dir):
    return op.beats(slots(spark, sf_dir), 2, "assistant")


def _islands(source: str, keys: str, order: str = "pos") -> str:
    same = " AND ".join(f"{k} IS NOT DISTINCT FROM lag({k}) OVER w" for k in keys.split(", "))
    return f"""isl AS (SELECT *, sum(fresh) OVER (PARTITION BY chapter ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN {same} AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY chapter ORDER BY {order})))"""


@query("w05_spans", f"""WITH {_SLOTS}, {_islands('slots', 'scene')} SELECT chapter, CAST(island AS BIGINT) AS island, scene, min(start) AS start, max("end") AS "end", count(*) AS lines FROM isl GROUP BY chapter, island, scene""")
def spans(spark, sf_dir):
    return op.spans(slots(spark, sf_dir), ["scene"])


_EV = "ev AS (SELECT user_id AS chapter, event_id AS pos, event_type AS kind, epoch_us(ts) // 1000 AS start, epoch_us(ts) // 1000 + 1000 AS \"end\" FROM events)"


def event_lines(spark, sf_dir):
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chapter"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), ts.alias("start"), (ts + 1000).alias("end"))


@query("w05_event_islands", f"""WITH {_EV}, {_islands('ev', 'kind')} SELECT chapter, CAST(island AS BIGINT) AS island, kind, min(start) AS start, max("end") AS "end", count(*) AS lines FROM isl GROUP BY chapter, island, kind""")
def event_islands(spark, sf_dir):
    return op.spans(event_lines(spark, sf_dir), ["kind"])


_RUNS = f"""{_SLOTS}, voiced AS (SELECT * FROM slots WHERE trim(music) NOT IN ('', 'none')), {_islands('voiced', 'music')},
  runs AS (SELECT chapter, CAST(island AS BIGINT) AS island, music, min(start) AS start, max("end") AS "end", count(*) AS lines FROM isl GROUP BY chapter, island, music)"""


@query("w07_music_runs", f"WITH {_RUNS} SELECT * FROM runs")
def music_runs(spark, sf_dir):
    return op.music_runs(slots(spark, sf_dir))


@query("w08_solo_holds", f"""WITH {_SLOTS}, solo AS (SELECT chapter, pos, sum(h) AS hold FROM (SELECT chapter, pos, 100 * (pos % 3) AS h FROM slots0 WHERE pos % 2 = 0 UNION ALL SELECT chapter, pos, 50 FROM slots0 WHERE pos % 4 = 0) GROUP BY ALL),
    held AS (SELECT s.chapter, s.pos, dur, pause, gap + coalesce(hold, 0) AS gap FROM slots0 s LEFT JOIN solo USING (chapter, pos))
    SELECT chapter, pos, CAST(gap AS BIGINT) AS gap, CAST(coalesce(sum(dur + gap + pause) OVER (PARTITION BY chapter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM held""")
def solo_holds(spark, sf_dir):
    own = lines(spark, sf_dir)
    solo = own.where("pos % 2 = 0").select("chapter", "pos", (100 * (F.col("pos") % 3)).alias("hold")).union(own.where("pos % 4 = 0").select("chapter", "pos", F.lit(50)))
    return op.holds(own, solo).select("chapter", "pos", "gap", "start")


@query("w16_music_starts", f"""WITH {_RUNS} SELECT chapter, island, CASE WHEN start - b BETWEEN 0 AND 1500 THEN b ELSE start END AS effective FROM (SELECT *, lag("end") OVER (PARTITION BY chapter ORDER BY island) AS b FROM runs)""")
def music_starts(spark, sf_dir):
    return op.music_starts(op.music_runs(slots(spark, sf_dir)), 500).select("chapter", "island", "effective")


@query("w27_edge_fades", f"""WITH {_RUNS} SELECT chapter, island, CASE WHEN row_number() OVER (PARTITION BY chapter ORDER BY island) = 1 THEN 3000 ELSE 500 END AS fade_in, CASE WHEN row_number() OVER (PARTITION BY chapter ORDER BY island DESC) = 1 THEN 3000 ELSE 500 END AS fade_out FROM runs""")
def edge_fades(spark, sf_dir):
    return op.edge_fades(op.music_runs(slots(spark, sf_dir)), 3000, 500).select("chapter", "island", "fade_in", "fade_out")


_CARRY = f"""WITH {_SLOTS} SELECT chapter, pos, last_value(nullif(trim(scene), '') IGNORE NULLS) OVER w AS scene, last_value(nullif(trim(music), '') IGNORE NULLS) OVER w AS music FROM slots WINDOW w AS (PARTITION BY chapter ORDER BY pos ROWS UNBOUNDED PRECEDING)"""


@query("w11_carry_forward", _CARRY)
def carry_forward(spark, sf_dir):
    return op.carry_forward(lines(spark, sf_dir), ["scene", "music"]).select("chapter", "pos", "scene", "music")


@query("w12_adjacent_repeats", """WITH t AS (SELECT conv_id AS chapter, turn AS pos, CASE WHEN turn % 3 = 2 THEN 'again' ELSE text END AS text, 'x' || turn // 2 AS speaker FROM conversations),
    b AS (SELECT *, lag(text) OVER w AS said, lag(speaker) OVER w AS by_ FROM (SELECT chapter, pos, CASE WHEN pos % 4 > 1 THEN 'same' ELSE text END AS text, speaker FROM t) WINDOW w AS (PARTITION BY chapter ORDER BY pos))
    SELECT chapter, pos FROM b WHERE text = said AND speaker = by_""")
def adjacent_repeats(spark, sf_dir):
    t = lines(spark, sf_dir).withColumn("speaker", F.concat(F.lit("x"), F.floor(F.col("pos") / 2)))
    t = t.withColumn("text", F.when(F.col("pos") % 4 > 1, "same").when(F.col("pos") % 3 == 2, "again").otherwise(F.col("text")))
    return op.adjacent_repeats(t)


_PARTS = f"""{_SLOTS}, split AS (SELECT chapter, pos, start, "end", dur, unnest(p) AS text, unnest(range(len(p))) AS part FROM (SELECT *, string_split(text, '. ') AS p FROM slots)),
  w AS (SELECT *, greatest(length(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]', '', 'g')), 1) AS w FROM split)"""


def _parts(spark, sf_dir):
    return slots(spark, sf_dir).select("chapter", "pos", "start", "end", "dur", F.posexplode(F.split("text", r"\. ", -1)).alias("part", "text"))


@query("w13_cue_sheet", f"""WITH {_PARTS}, u AS (SELECT *, sum(w) OVER (PARTITION BY chapter, pos ORDER BY part ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY chapter, pos) AS total FROM w)
    SELECT chapter, pos, CAST(part AS INTEGER) AS part, round(start + CAST(("end" - start) * (upto - w) AS DOUBLE) / CAST(total AS DOUBLE), 4) AS "from",
      round(CASE WHEN upto = total THEN CAST("end" AS DOUBLE) ELSE start + CAST(("end" - start) * upto AS DOUBLE) / CAST(total AS DOUBLE) END, 4) AS "to" FROM u""")
def cue_sheet(spark, sf_dir):
    return op.cue_sheet(_parts(spark, sf_dir)).select("chapter", "pos", "part", F.round("from", 4).alias("from"), F.round("to", 4).alias("to"))


@query("w14_caption_shares", f"""WITH {_PARTS}, p AS (SELECT *, greatest(sum(w) OVER l, 1) AS total, count(*) OVER l AS n FROM w WINDOW l AS (PARTITION BY chapter, pos)),
    s AS (SELECT *, part = n - 1 AS last, CASE WHEN part = n - 1 THEN CAST(dur * w AS DOUBLE) / CAST(total AS DOUBLE) ELSE least(greatest(CAST(dur * w AS DOUBLE) / CAST(total AS DOUBLE), 1200.0), 6000.0) END AS share FROM p),
    r AS (SELECT *, dur - sum(share) OVER l AS rest, sum(CASE WHEN NOT last AND share > 1200 THEN share - 1200 ELSE 0.0 END) OVER l AS pool FROM s WINDOW l AS (PARTITION BY chapter, pos))
    SELECT chapter, pos, CAST(part AS INTEGER) AS part, round(CASE WHEN last AND rest > 0 THEN share + rest WHEN last THEN greatest(share, 0.0)
      WHEN rest < 0 AND share > 1200 AND pool > 0 THEN share + rest * (share - 1200) / pool ELSE share END, 3) AS share FROM r""")
def caption_shares(spark, sf_dir):
    parts = _parts(spark, sf_dir).withColumn("w", F.greatest(F.length(F.regexp_replace("text", r"[ \t\n\r\f\x0B]", "")), F.lit(1)))
    return op.caption_shares(parts, 1200.0, 6000.0).select("chapter", "pos", "part", F.round("share", 3).alias("share"))


_SNAP = f"""{_SLOTS}, f AS (SELECT chapter, pos, CAST(round(start * 24 / 1000::DOUBLE) AS BIGINT) AS first, greatest(CAST(round("end" * 24 / 1000::DOUBLE) AS BIGINT), CAST(round(start * 24 / 1000::DOUBLE) AS BIGINT) + 1) AS l FROM slots),
  snapped AS (SELECT chapter, pos, first, least(l, coalesce(lead(first) OVER (PARTITION BY chapter ORDER BY first, pos), l)) AS last FROM f)"""


@query("w15_caption_frames", f"WITH {_SNAP} SELECT * FROM snapped")
def caption_frames(spark, sf_dir):
    return op.snap(slots(spark, sf_dir), 24)


@query("w25_frame_timeline", f"""WITH {_SNAP} SELECT chapter, pos, unnest(range(first, last)) AS frame FROM snapped WHERE last > first""")
def frame_timeline(spark, sf_dir):
    return op.frames(op.snap(slots(spark, sf_dir), 24))


_ITEMS = "items AS (SELECT conv_id AS chapter, turn AS pos, CASE WHEN turn % 5 = 1 THEN 'rain' WHEN turn % 5 = 2 AND conv_id % 2 = 0 THEN 'fire' END AS sound, CASE WHEN turn % 5 = 4 AND conv_id % 3 > 0 THEN 'rain' WHEN turn = 7 THEN 'fire' END AS stop, turn % 2 = 0 OR turn > 4 AS spoken FROM conversations)"
_BEDS = f"""{_ITEMS}, cnt AS (SELECT *, sum(CAST(spoken AS BIGINT)) OVER (PARTITION BY chapter ORDER BY pos ROWS UNBOUNDED PRECEDING) AS line FROM items),
  marks AS (SELECT chapter, pos, line, coalesce(sound, stop) AS bed, sound IS NOT NULL AS opens FROM cnt WHERE sound IS NOT NULL OR stop IS NOT NULL),
  opened AS (SELECT * FROM (SELECT *, lag(opens) OVER (PARTITION BY chapter, bed ORDER BY pos) AS again FROM marks) WHERE (opens AND NOT coalesce(again, false)) OR NOT opens),
  beds AS (SELECT chapter, bed, pos AS "from", np AS "to", CAST(nl - line AS BIGINT) AS lines FROM (SELECT *, lead(CASE WHEN NOT opens THEN pos END) OVER o AS np, lead(CASE WHEN NOT opens THEN line END) OVER o AS nl FROM opened WINDOW o AS (PARTITION BY chapter, bed ORDER BY pos)) WHERE opens)"""


def items(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("chapter"), turn.alias("pos"), F.when(turn % 5 == 1, "rain").when((turn % 5 == 2) & (conv % 2 == 0), "fire").alias("sound"),
        F.when((turn % 5 == 4) & (conv % 3 > 0), "rain").when(turn == 7, "fire").alias("stop"), ((turn % 2 == 0) | (turn > 4)).alias("spoken"),
    )


@query("w17_open_beds", f'WITH {_BEDS} SELECT chapter, bed, "from" FROM beds WHERE "to" IS NULL')
def open_beds(spark, sf_dir):
    return op.bed_spans(items(spark, sf_dir)).where("to is null").select("chapter", "bed", "from")


_MOST = "greatest(CAST(ceil(s.n * 20 / 100::DOUBLE) AS BIGINT), 1)"


@query("w18_overlong_beds", f"""WITH {_BEDS}, s AS (SELECT chapter, sum(CAST(spoken AS BIGINT)) AS n FROM items GROUP BY chapter) SELECT b.*, {_MOST} AS most FROM beds b JOIN s USING (chapter) WHERE s.n > 0 AND b.lines > {_MOST}""")
def overlong_beds(spark, sf_dir):
    own = items(spark, sf_dir)
    return op.overlong(op.bed_spans(own), own)


@query("w20_drop_open_openings", f"""WITH {_BEDS} SELECT i.chapter, i.pos, i.sound, i.stop FROM items i ANTI JOIN (SELECT chapter, "from" AS pos FROM beds WHERE "to" IS NULL) o USING (chapter, pos)""")
def drop_open_openings(spark, sf_dir):
    own = items(spark, sf_dir)
    gone = op.bed_spans(own).where("to is null").select("chapter", F.col("from").alias("pos"))
    return own.join(gone, ["chapter", "pos"], "left_anti").select("chapter", "pos", "sound", "stop")


@query("w21_missing_runs", """WITH gone AS (SELECT l_orderkey AS chapter, l_partkey % 50 AS pos FROM lineitem WHERE l_linenumber > 2 EXCEPT SELECT l_orderkey, l_suppkey % 50 FROM lineitem)
    SELECT chapter, min(pos) AS "from", count(*) AS count FROM (SELECT *, pos - row_number() OVER (PARTITION BY chapter ORDER BY pos) AS run FROM gone) GROUP BY chapter, run""")
def missing_runs(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    expected = l.where("l_linenumber > 2").select(F.col("l_orderkey").alias("chapter"), (F.col("l_partkey") % 50).alias("pos")).distinct()
    return op.missing_runs(expected, l.select(F.col("l_orderkey").alias("chapter"), (F.col("l_suppkey") % 50).alias("pos")))


_LAID = "laid AS (SELECT chapter, dur, CAST(coalesce(sum(dur + 500) OVER (ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT chapter, CAST(sum(dur) AS BIGINT) AS dur FROM slots GROUP BY chapter))"


def chapters(spark, sf_dir):
    return op.chapters_on_clock(lines(spark, sf_dir).groupBy("chapter").agg(F.sum("dur").alias("dur")), 500)


@query("w32_chapters_on_clock", f"WITH {_SLOTS}, {_LAID} SELECT chapter, dur, start FROM laid")
def chapters_on_clock(spark, sf_dir):
    return chapters(spark, sf_dir)


@query("w31_cue_windows", f"""WITH {_SLOTS}, {_LAID} SELECT s.chapter, s.pos, s.start + c.start AS "from", s."end" + c.start AS "to" FROM slots s JOIN laid c USING (chapter)""")
def cue_windows(spark, sf_dir):
    clock = chapters(spark, sf_dir).select("chapter", F.col("start").alias("offset"))
    s = slots(spark, sf_dir).join(clock, "chapter")
    return s.select("chapter", "pos", (F.col("start") + F.col("offset")).alias("from"), (F.col("end") + F.col("offset")).alias("to"))


@query("w30_outline", f"""WITH {_SLOTS}, {_LAID} SELECT chapter // 7 AS act, arg_min(start, chapter) AS start FROM laid GROUP BY act""")
def outline(spark, sf_dir):
    return chapters(spark, sf_dir).groupBy(F.floor(F.col("chapter") / 7).alias("act")).agg(F.min_by("start", "chapter").alias("start"))


@query("j17_slot_in_span", f"""WITH {_SLOTS}, {_islands('slots', 'scene')}, sp AS (SELECT chapter, CAST(island AS BIGINT) AS span, min(start) AS s, max("end") AS e FROM isl GROUP BY chapter, island),
    p AS (SELECT chapter, pos, start + 300 AS at FROM slots)
    SELECT p.chapter, p.pos, arg_min(sp.span, sp.s) AS span FROM p LEFT JOIN sp ON sp.chapter = p.chapter AND sp.s <= p.at AND p.at < sp.e GROUP BY p.chapter, p.pos""")
def slot_in_span(spark, sf_dir):
    own = slots(spark, sf_dir)
    windows = op.spans(own, ["scene"]).select("chapter", F.col("island").alias("span"), "start", "end")
    return op.in_span(own.select("chapter", "pos", (F.col("start") + 300).alias("at")), windows, 5000).select("chapter", "pos", "span")


@query("j18_interval_overlap", f"""WITH {_RUNS}, pz AS (SELECT chapter, pos, "end" AS "from", "end" + pause AS "to" FROM slots WHERE pause > 0)
    SELECT r.chapter, r.island, p.pos FROM runs r JOIN pz p ON p.chapter = r.chapter AND p."to" > r.start AND p."from" < r."end" """)
def interval_overlap(spark, sf_dir):
    own = slots(spark, sf_dir)
    return op.overlaps(op.music_runs(own), op.pause_intervals(own), 5000).select("chapter", "island", "pos")


@query("j19_act_at_frame", f"""WITH {_SLOTS}, {_LAID} SELECT e.event_id, max(a.chapter) AS act FROM (SELECT event_id, event_id * 97 % 200000 AS at FROM events) e LEFT JOIN laid a ON a.start <= e.at AND e.at < a.start + a.dur GROUP BY e.event_id""")
def act_at_frame(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(F.lit(0).alias("chapter"), F.col("event_id").alias("pos"), (F.col("event_id") * 97 % 200000).alias("at"))
    acts = chapters(spark, sf_dir).select(F.lit(0).alias("chapter"), F.col("chapter").alias("span"), "start", (F.col("start") + F.col("dur")).alias("end"))
    return op.in_span(points, acts, 20000).select(F.col("pos").alias("event_id"), F.col("span").alias("act"))


@query("j25_previous_excerpts", """WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '' ELSE substr(text, 1, 20) END AS excerpt FROM conversations)
    SELECT conv_id, turn, list_filter(list_reverse(coalesce(list(excerpt) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), [])), lambda x: trim(x) <> '') AS excerpts FROM e""")
def previous_excerpts(spark, sf_dir):
    from pyspark.sql import Window as W

    excerpt = F.when(F.col("turn") % 3 == 1, "").otherwise(F.substring("text", 1, 20))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", excerpt.alias("excerpt"))
    before = F.collect_list("excerpt").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1))
    return own.select("conv_id", "turn", F.filter(F.reverse(before), lambda x: F.trim(x) != "").alias("excerpts"))
