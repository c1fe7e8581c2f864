"""Laying lines out on a clock: slots, spans, runs, cues and captions.

Frames carry `chapter` and `pos`; all windows are partitioned by chapter, so chapters are laid out side by side. Times are
whole milliseconds until a result needs fractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def by_chapter() -> WindowSpec:
    return W.partitionBy("chapter")


def line_order() -> WindowSpec:
    return by_chapter().orderBy("pos")


def lines_before() -> WindowSpec:
    return line_order().rowsBetween(W.unboundedPreceding, -1)


def lines_so_far() -> WindowSpec:
    return line_order().rowsBetween(W.unboundedPreceding, W.currentRow)


def half_away(x: Column) -> Column:
    """Rounded to whole numbers, halves away from zero."""
    return F.round(x).cast("long")


def layout(slots: DataFrame) -> DataFrame:
    """slots: dur, gap, pause in ms. Adds start and end: each line starts when all before it and their silences are over."""
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap") + F.col("pause")).over(lines_before()), F.lit(0))
    return slots.withColumn("start", start).withColumn("end", F.col("start") + F.col("dur"))


def retime(slots: DataFrame, speed: float) -> DataFrame:
    scaled = {c: half_away(F.col(c) / F.lit(speed)) for c in ("start", "end", "gap", "pause")}
    return slots.withColumns(scaled) if speed > 0 and speed != 1 else slots


def pause_intervals(slots: DataFrame) -> DataFrame:
    return slots.where("pause > 0").select("chapter", "pos", F.col("end").alias("from"), (F.col("end") + F.col("pause")).alias("to"))


def headline_end(slots: DataFrame) -> DataFrame:
    """Where a first line without scene and music ends."""
    first = slots.withColumn("k", F.row_number().over(line_order())).where("k = 1 and end > 0 and scene = '' and music = ''")
    return first.select("chapter", F.col("end").alias("headline_end"))


def beats(slots: DataFrame, most: int, narrator: str | None = None) -> DataFrame:
    """Scene changes worth a pause: narrator's lines first, then longer pauses, then earlier; at most `most` a chapter.
    With narrator given, one of the two lines must be the narrator's."""
    both = slots.withColumns({"before": F.lag("scene").over(line_order()), "speaker_before": F.lag("speaker").over(line_order())})
    change = (F.col("before") != "") & (F.col("scene") != "") & (F.col("before") != F.col("scene"))
    if narrator is not None:
        change = change & ((F.col("speaker") == narrator) | (F.col("speaker_before") == narrator))
    rank = F.when(F.col("speaker") == narrator, 2).otherwise(1) if narrator is not None else F.lit(1)
    placed = both.where(change).withColumn("rank", rank)
    best = placed.withColumn("k", F.row_number().over(by_chapter().orderBy(F.desc("rank"), F.desc("pause"), "pos")))
    return best.where(F.col("k") <= most).select("chapter", "pos", "rank", "pause")


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `island`, a number that grows whenever one of keys differs from the line before (null equals null)."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(line_order()))
    changed = F.when(same & F.lag(F.lit(1)).over(line_order()).isNotNull(), 0).otherwise(1)
    return rows.withColumn("__new", changed).withColumn("island", F.sum("__new").over(lines_so_far())).drop("__new")


def spans(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours of equal keys as one interval: chapter, island, keys, start, end, lines."""
    met = islands(slots, keys).groupBy("chapter", "island", *keys)
    return met.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("lines"))


def music_runs(slots: DataFrame) -> DataFrame:
    """Lines with music, neighbours of one sound joined; silent lines between do not part a run."""
    return spans(slots.where("trim(music) not in ('', 'none')"), ["music"])


def music_starts(runs: DataFrame, xfade: int) -> DataFrame:
    """A run that follows the one before within xfade + 1 s starts where that one ends."""
    line = by_chapter().orderBy("island")
    before = F.lag("end").over(line)
    gap = F.col("start") - before
    return runs.withColumn("effective", F.when((gap >= 0) & (gap <= xfade + 1000), before).otherwise(F.col("start")))


def edge_fades(runs: DataFrame, fade: int, xfade: int) -> DataFrame:
    first, last = F.row_number().over(by_chapter().orderBy("island")), F.row_number().over(by_chapter().orderBy(F.desc("island")))
    return runs.withColumns({"fade_in": F.when(first == 1, fade).otherwise(xfade), "fade_out": F.when(last == 1, fade).otherwise(xfade)})


def holds(slots: DataFrame, solo: DataFrame) -> DataFrame:
    """slots laid out anew with the sum of solo times (chapter, pos, hold) of each line added to its gap."""
    total = solo.groupBy("chapter", "pos").agg(F.sum("hold").alias("hold"))
    added = slots.join(total, ["chapter", "pos"], "left").withColumn("gap", F.col("gap") + F.coalesce("hold", F.lit(0)))
    return layout(added.drop("hold"))


def cue_sheet(parts: DataFrame) -> DataFrame:
    """parts: chapter, pos, part, text, start, end of the line. Each part gets time by its characters that are not white
    space (one at least); the last one ends with the line."""
    weight = F.greatest(F.length(F.regexp_replace("text", r"[ \t\n\r\f\x0B]", "")), F.lit(1))
    line = W.partitionBy("chapter", "pos")
    order = line.orderBy("part")
    w = parts.withColumn("w", weight)
    w = w.withColumns({"upto": F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("w").over(line)})
    span = F.col("end") - F.col("start")
    at = lambda share: F.col("start") + span * share / F.col("all")
    return w.select("chapter", "pos", "part", at(F.col("upto") - F.col("w")).alias("from"), F.when(F.col("upto") == F.col("all"), F.col("end")).otherwise(at(F.col("upto"))).alias("to"))


def caption_shares(parts: DataFrame, least: float, most: float) -> DataFrame:
    """Proportional shares of dur, all but the last clamped to least .. most; the last takes what is left, and if that is
    negative the others give back in proportion to what they have over `least`."""
    line = W.partitionBy("chapter", "pos")
    p = parts.withColumns({"all": F.greatest(F.sum("w").over(line), F.lit(1)), "n": F.count(F.lit(1)).over(line)})
    last = F.col("part") == F.col("n") - 1
    raw = F.col("dur") * F.col("w") / F.col("all")
    p = p.withColumn("share", F.when(last, raw).otherwise(F.least(F.greatest(raw, F.lit(least)), F.lit(most))))
    p = p.withColumns({"rest": F.col("dur") - F.sum("share").over(line), "pool": F.sum(F.when(~last & (F.col("share") > least), F.col("share") - least).otherwise(0.0)).over(line)})
    given = F.when(~last & (F.col("rest") < 0) & (F.col("share") > least) & (F.col("pool") > 0), F.col("share") + F.col("rest") * (F.col("share") - least) / F.col("pool"))
    ends = F.when(last & (F.col("rest") > 0), F.col("share") + F.col("rest")).when(last, F.greatest("share", F.lit(0.0)))
    return p.select("chapter", "pos", "part", F.coalesce(ends, given, F.col("share")).alias("share"))


def snap(captions: DataFrame, fps: int) -> DataFrame:
    """Starts and ends in frames; a caption has one frame at least and ends when the next one starts."""
    frame = lambda c: half_away(F.col(c) * fps / F.lit(1000))
    snapped = captions.select("chapter", "pos", frame("start").alias("first"), F.greatest(frame("end"), frame("start") + 1).alias("last"))
    following = F.lead("first").over(by_chapter().orderBy("first", "pos"))
    return snapped.withColumn("last", F.least("last", F.coalesce(following, F.col("last"))))


def chapters_on_clock(chapters: DataFrame, gap: int) -> DataFrame:
    """Chapters one after another with a gap between. Sums run within ranges of 1,024 chapter numbers; only the ranges'
    totals, a thousandth of the rows, are summed along the whole clock."""
    ranged = chapters.withColumn("range", F.floor(F.col("chapter") / 1024))
    so_far = lambda w: F.coalesce(F.sum("all").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy("range").agg(F.sum(F.col("dur") + gap).alias("all")).select("range", so_far(W.orderBy("range")).alias("before"))
    own = ranged.withColumn("all", F.col("dur") + gap).withColumn("own", so_far(W.partitionBy("range").orderBy("chapter")))
    return own.join(totals, "range").withColumn("start", F.col("own") + F.col("before")).drop("range", "all", "own", "before")


def missing_runs(expected: DataFrame, present: DataFrame) -> DataFrame:
    """chapter, from, count of each run of neighbouring pos that is expected but not present."""
    gone = expected.join(present, ["chapter", "pos"], "left_anti")
    run = F.col("pos") - F.row_number().over(line_order())
    return gone.withColumn("run", run).groupBy("chapter", "run").agg(F.min("pos").alias("from"), F.count(F.lit(1)).alias("count")).drop("run")


def gaps(present: DataFrame) -> DataFrame:
    """chapter, from, count of each run of pos from 0 up to the chapter's last that is not present: what lies between each
    pos and the one before it. Nothing is made for the places themselves, however far apart they are."""
    before = F.coalesce(F.lag("pos").over(line_order()), F.lit(-1))
    apart = present.select("chapter", "pos").distinct().withColumn("from", before + 1)
    return apart.where(F.col("pos") > F.col("from")).select("chapter", "from", (F.col("pos") - F.col("from")).alias("count"))


def carry_forward(lines: DataFrame, fields: list[str]) -> DataFrame:
    """The last value that is not blank."""
    filled = lambda c: F.last(F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))), ignorenulls=True).over(lines_so_far())
    return lines.withColumns({c: filled(c) for c in fields})


def adjacent_repeats(lines: DataFrame) -> DataFrame:
    """Lines that say what the line before said, unless the speaker changed."""
    both = lines.withColumns({"said": F.lag("text").over(line_order()), "by": F.lag("speaker").over(line_order())})
    return both.where("text = said and speaker = by").select("chapter", "pos")


def bed_spans(items: DataFrame) -> DataFrame:
    """items: chapter, pos, sound (a bed that starts), stop (a bed that stops), spoken. A start counts if its bed is not
    open already; each is paired with the next stop of that bed. Returns chapter, bed, from, to (null: never stopped)
    and lines spoken in between."""
    counted = items.withColumn("line", F.sum(F.col("spoken").cast("long")).over(lines_so_far()))
    marks = counted.where("sound is not null or stop is not null").select("chapter", "pos", "line", F.coalesce("sound", "stop").alias("bed"), F.col("sound").isNotNull().alias("opens"))
    order = W.partitionBy("chapter", "bed").orderBy("pos")
    opened = marks.withColumn("again", F.lag("opens").over(order)).where("opens and not coalesce(again, false) or not opens")
    after = F.lead(F.when(~F.col("opens"), F.struct("pos", "line"))).over(order)
    stop = opened.withColumn("next_stop", after).where("opens")
    return stop.select("chapter", "bed", F.col("pos").alias("from"), F.col("next_stop.pos").alias("to"), (F.col("next_stop.line") - F.col("line")).alias("lines"))


def overlong(beds: DataFrame, items: DataFrame, percent: int = 20) -> DataFrame:
    """Beds over more than a share of the chapter's lines (rounded up, one at least)."""
    lines = items.groupBy("chapter").agg(F.sum(F.col("spoken").cast("long")).alias("spoken"))
    most = F.greatest(F.ceil(F.col("spoken") * percent / 100), F.lit(1))
    return beds.join(lines, "chapter").where((F.col("spoken") > 0) & (F.col("lines") > most)).select(*beds.columns, most.alias("most"))


def frames(captions: DataFrame) -> DataFrame:
    """One row per frame of each caption (first <= frame < last)."""
    return captions.where("last > first").select("chapter", "pos", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("frame"))


def in_span(points: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """points (chapter, pos, at) with the window (chapter, span, start, end) that holds them: start <= at < end, the
    earliest if several do. Windows are cut into buckets of `width`, so the join is one of equal keys."""
    bucket = lambda c: F.floor(c / width)
    cut = windows.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.greatest(F.col("end") - 1, F.col("start"))))))
    met = points.withColumn("bucket", bucket(F.col("at"))).join(cut, ["chapter", "bucket"]).where("start <= at and at < end")
    best = met.groupBy("chapter", "pos").agg(F.min_by("span", "start").alias("span"))
    return points.join(best, ["chapter", "pos"], "left")


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of intervals of one chapter with right.to > left.start and right.from < left.end, by buckets; a pair counts in
    the bucket where the later of the two begins."""
    a = left.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))))
    b = right.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(F.greatest(F.col("to") - 1, F.col("from")) / width))))
    met = a.join(b, ["chapter", "bucket"]).where((F.col("to") > F.col("start")) & (F.col("from") < F.col("end")))
    return met.where(F.col("bucket") == F.floor(F.greatest("start", "from") / width)).drop("bucket")
