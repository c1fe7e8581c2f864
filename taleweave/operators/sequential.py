"""Order-dependent operators: greedy batches, budgets, assignments, envelopes and keys.

Where "since the last cut" or "what is left" decides, one ordered array per chapter is folded with `aggregate`; the arrays
hold the lines of one chapter, whose number does not follow the data. Only what no expression can say is Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from taleweave.functions.text import ends_sentence, sentence_ends
from taleweave.operators.slices import slices

CELL = 1024  # width of a range of positions that is numbered by itself
OVERHEAD = 64  # characters that a line costs besides its text


def ordered(rows: DataFrame, fields: list[str]) -> DataFrame:
    """chapter, items: the rows of each chapter as one array in order of pos."""
    return rows.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("items"))


def batches(lines: DataFrame, sentences: int, chars: int) -> DataFrame:
    """Greedy windows over lines (chapter, pos, text): closed at a sentence end once enough sentences or characters are in,
    and at one and a half times the characters in any case. Returns chapter, window, from, to, lines, chars, sentences."""
    cost = lines.select("chapter", "pos", (F.length("text") + OVERHEAD).cast("long").alias("w"), sentence_ends(F.col("text")).cast("long").alias("s"), ends_sentence(F.col("text")).alias("e"))
    zero = F.lit(0).cast("long")
    kind = "array<struct<to:bigint,chars:bigint,sentences:bigint,lines:bigint>>"
    start = F.struct(zero.alias("c"), zero.alias("s"), zero.alias("n"), F.array().cast(kind).alias("out"), F.lit(-1).cast("long").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        c, s, n = acc["c"] + x["w"], acc["s"] + x["s"], acc["n"] + 1
        close = (F.lit(sentences > 0) & (s >= sentences) & x["e"]) | (F.lit(chars > 0) & (c >= chars) & (x["e"] | (c >= chars + chars // 2)))
        entry = F.struct(x["pos"].cast("long").alias("to"), c.alias("chars"), s.alias("sentences"), n.alias("lines"))
        out = F.when(close, F.array_append(acc["out"], entry)).otherwise(acc["out"])
        keep = lambda v: F.when(close, zero).otherwise(v)
        return F.struct(keep(c).alias("c"), keep(s).alias("s"), keep(n).alias("n"), out.alias("out"), x["pos"].cast("long").alias("last"))

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["last"].alias("to"), acc["c"].alias("chars"), acc["s"].alias("sentences"), acc["n"].alias("lines"))
        return F.when(acc["n"] > 0, F.array_append(acc["out"], rest)).otherwise(acc["out"])

    folded = ordered(cost, ["w", "s", "e"]).select("chapter", F.posexplode(F.aggregate("items", start, step, finish)).alias("window", "x"))
    return folded.select("chapter", "window", "x.to", "x.lines", "x.chars", "x.sentences")


def effect_windows(spans: DataFrame, coverage: float, least: int, most: int, cooldown: int) -> DataFrame:
    """Stretches of spans (chapter, pos, start, end, on) that carry an effect, in order, until a share of the chapter is
    used: each at least `least` and at most `most` long and `cooldown` after the one before. Returns chapter, span, from, to."""
    total = spans.groupBy("chapter").agg(F.max("end").alias("total"))
    long = lambda v: F.lit(v).cast("long")
    kind = "array<struct<span:bigint,from:bigint,to:bigint>>"
    start = F.struct(long(0).alias("used"), long(0).alias("free"), F.lit(False).alias("full"), F.array().cast(kind).alias("out"))
    budget = F.floor(F.col("total") * F.lit(coverage))

    def step(acc: Column, x: Column) -> Column:
        at = F.greatest(x["start"], acc["free"])
        room = budget - acc["used"]
        tried = ~acc["full"] & x["on"] & (x["end"] - x["start"] >= least) & (at < x["end"])
        size = F.least(x["end"] - at, long(most), room)
        taken = tried & (room >= least) & (size >= least)
        entry = F.struct(x["pos"].cast("long").alias("span"), at.alias("from"), (at + size).alias("to"))
        return F.struct(
            F.when(taken, acc["used"] + size).otherwise(acc["used"]).alias("used"), F.when(taken, at + size + cooldown).otherwise(acc["free"]).alias("free"),
            (acc["full"] | (tried & (room < least))).alias("full"), F.when(taken, F.array_append(acc["out"], entry)).otherwise(acc["out"]).alias("out"),
        )

    folded = ordered(spans, ["start", "end", "on"]).join(total, "chapter").select("chapter", F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("x"))
    return folded.select("chapter", "x.*")


def inject_events(directives: DataFrame) -> DataFrame:
    """Spot sounds on the clock. directives: chapter, pos, k (order on the line), end (of the line), sound, dur, advance
    (how far the queue moves), looped, stop. A directive starts when those before it on its line are through; it ends
    with its clip, or when its sound starts again or is stopped; a loop that is never stopped plays once."""
    line = W.partitionBy("chapter", "pos").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    at = directives.withColumn("at", F.col("end") + F.coalesce(F.sum("advance").over(line), F.lit(0)))
    after = F.lead("at").over(W.partitionBy("chapter", "sound").orderBy("pos", "k"))
    natural = F.col("at") + F.col("dur")
    ends = F.when(F.col("looped"), F.coalesce("after", natural)).otherwise(F.least(natural, F.coalesce("after", natural)))
    out = at.withColumn("after", after).where("not stop").select("chapter", "pos", "k", "sound", F.col("at").alias("from"), ends.alias("to"))
    return out.where("to > from")


@F.pandas_udf(DoubleType())
def _log(x: pd.Series) -> pd.Series:
    """The C library's logarithm, which databases use too; the JVM's own differs in the last bit. 0 gives -inf."""
    return pd.Series([None if pd.isna(v) or v < 0 else math.log(v) if v else -math.inf for v in x], dtype="float64")


@F.pandas_udf(DoubleType())
def _exp(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else math.exp(v) for v in x], dtype="float64")


def release_hold(levels: DataFrame, decay: float) -> DataFrame:
    """Peak follower h = max(x, decay * h before) over levels (chapter, pos, x >= 0), as a running maximum in logarithms."""
    fall = F.col("pos") * F.lit(math.log(decay))
    so_far = W.partitionBy("chapter").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    peak = levels.withColumn("__log", _log(F.col("x").cast("double"))).withColumn("__peak", F.max(F.col("__log") - fall).over(so_far) + fall)
    return peak.withColumn("hold", _exp(F.col("__peak"))).drop("__log", "__peak")


def decimate(series: DataFrame, tolerance: float) -> DataFrame:
    """Frames of each series (chapter, items: array of struct pos, y) that need a key so that straight lines between keys
    stay within tolerance of all frames: the slopes that pass every pin since the last key form an interval, and a chord
    outside it makes the frame before a key."""
    kind = "array<bigint>"
    inf = F.lit(float("inf"))
    first = F.element_at("items", 1)
    start = F.struct(
        first["pos"].cast("long").alias("a"), first["y"].alias("b"), (-inf).alias("lo"), inf.alias("hi"), first["pos"].cast("long").alias("p"), first["y"].alias("py"), F.array(first["pos"].cast("long")).cast(kind).alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        i, slope = x["pos"].cast("long"), (x["y"] - acc["b"]) / (x["pos"] - acc["a"])
        cut = (i > acc["a"] + 1) & ~((acc["lo"] <= slope) & (slope <= acc["hi"]))
        a, b = F.when(cut, acc["p"]).otherwise(acc["a"]), F.when(cut, acc["py"]).otherwise(acc["b"])
        pin = lambda t: (x["y"] - b + t) / (x["pos"] - a)
        lo, hi = F.greatest(F.when(cut, -inf).otherwise(acc["lo"]), pin(-tolerance)), F.least(F.when(cut, inf).otherwise(acc["hi"]), pin(tolerance))
        out = F.when(cut, F.array_append(acc["out"], acc["p"])).otherwise(acc["out"])
        return F.struct(a.alias("a"), b.alias("b"), lo.alias("lo"), hi.alias("hi"), i.alias("p"), x["y"].alias("py"), out.alias("out"))

    finish = lambda acc: F.array_distinct(F.array_append(acc["out"], acc["p"]))
    rest = F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))
    return series.where(F.size("items") > 0).select("chapter", F.explode(F.aggregate(rest, start, step, finish)).alias("pos"))


def packed(parts: Column, most: int) -> Column:
    """Parts joined greedily by spaces into chunks of at most `most` characters; a tail of up to an eighth of that, 15 at
    most, may run over. A longer part stands alone."""
    slack = min(15, most // 8)
    start = F.struct(F.lit("").alias("b"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        size = F.when(acc["b"] == "", F.length(p)).otherwise(F.length(acc["b"]) + 1 + F.length(p))
        fits = (size <= most) | ((F.length(p) <= slack) & (size <= most + slack))
        both = F.when(acc["b"] == "", p).otherwise(F.concat(acc["b"], F.lit(" "), p))
        done = F.when(acc["b"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["b"]))
        return F.struct(F.when(fits, both).otherwise(p).alias("b"), F.when(fits, acc["out"]).otherwise(done).alias("out"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["b"] == "", a["out"]).otherwise(F.array_append(a["out"], a["b"])))


_EVENT = pa.schema([("chapter", pa.int64()), ("pos", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("open", pa.bool_())])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = []
        for chapter, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = (e for e in _events(text or "") if e[1].strip())
            rows += [(chapter, k, kind, part.strip(), a, b, o) for k, (kind, part, a, b, o) in enumerate(found)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_EVENT)], schema=_EVENT)


def quote_events(chapters: DataFrame) -> DataFrame:
    """Narration and dialogue of chapters (chapter, text): chapter, pos, kind, text, from, to (characters), open (the quote
    was never closed). Line ends part narration; a quoted term inside a sentence stays narration."""
    return chapters.select("chapter", "text").mapInArrow(_split, "chapter long, pos long, kind string, text string, `from` long, `to` long, open boolean")


_MARK, _CLOSE = re.compile('[\n"“「]'), re.compile('["”」]')


def _events(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    start = at = 0
    while (mark := _MARK.search(text, at)) is not None:
        at = mark.start()
        if mark.group() == "\n":
            yield "narration", text[start:at], start, at, False
            start = at = at + 1
            continue
        found = _CLOSE.search(text, at + 1)
        if found and _is_term(text, at, found.start()):
            at = found.end()
            continue
        yield "narration", text[start:at], start, at, False
        end = found.start() if found else len(text)
        yield "dialogue", text[at + 1 : end], at + 1, end, found is None
        start = at = end + 1
    yield "narration", text[start:], start, len(text), False


def _is_term(text: str, opened: int, closed: int) -> bool:
    inner = text[opened + 1 : closed].strip()
    small = inner and len(inner) <= 24 and not set(inner) & set("\n.!?…") and len(inner.split()) <= 4
    k, m = opened - 1, closed + 1
    while k >= 0 and text[k] != "\n" and text[k].isspace():
        k -= 1
    while m < len(text) and text[m] != "\n" and text[m].isspace():
        m += 1
    return bool(small and k >= 0 and text[k].isalnum() and m < len(text) and text[m] != "\n")


def assign_voices(speakers: DataFrame, voices: DataFrame) -> DataFrame:
    """speakers: chapter, pos, speaker, gender; voices: voice, gender, used, place. Each speaker in turn gets the voice of
    its gender that is used least in the chapter, then least overall, then comes first. Within a chapter and gender that
    is the list of voices by (used, place), taken round by round, so row numbers say it all. Rows are numbered within
    ranges of pos, and the ranges' sizes give the rest, so a chapter that holds the table is no single task."""
    by = W.partitionBy("gender")
    ranked = voices.withColumns({"turn": F.row_number().over(by.orderBy("used", "place")) - 1, "n": F.count(F.lit(1)).over(by)})
    cells = speakers.withColumn("cell", F.floor(F.col("pos") / CELL))
    before = W.partitionBy("chapter", "gender").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = cells.groupBy("chapter", "gender", "cell").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("chapter", "gender", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("chapter", "gender", "cell").orderBy("pos")) - 1
    asked = cells.withColumn("own", own).join(sizes, ["chapter", "gender", "cell"]).withColumn("k", F.col("own") + F.col("before"))
    sizes = ranked.select("gender", "n").distinct()
    turn = asked.join(sizes, "gender").withColumn("turn", F.col("k") % F.col("n"))
    return turn.join(ranked.drop("n"), ["gender", "turn"]).select("chapter", "pos", "speaker", "voice")
