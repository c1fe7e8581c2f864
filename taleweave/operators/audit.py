"""Verdicts on a chapter's quotes, on who speaks its lines and on generated speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.functions.numbers import VOWELS
from taleweave.functions.text import strip_cues
from taleweave.operators.sequential import quote_events
from taleweave.operators.speech import repaired_json

#: A block counts as speech above -18 dB of the peak; bursts are parted by over 60 ms and last 30 ms at least.
BURST_LEVEL, BURST_GAP, BURST_LEAST = 10 ** (-18 / 20), 6, 3
#: Above so many syllables bursts are not counted.
MOST_SYLLABLES = 3
SPAN = '["“「][^"”」]*["”」]'


def quote_findings(chapters: DataFrame) -> DataFrame:
    """chapter, pos, kind of quotes that never close, speeches over a paragraph end, and long speeches that prose runs into.
    chapters: chapter, text."""
    e = quote_events(chapters)
    before = F.lag(F.struct("kind", "text", "to")).over(W.partitionBy("chapter").orderBy("pos"))
    d = e.withColumn("b", before).where("kind = 'dialogue'")
    welded = (F.length("text") > 120) & (F.col("b.kind") == "narration") & (F.col("b.to") == F.col("from") - 1) & F.col("b.text").rlike(r"[\p{L}\p{N}]\z")
    kind = F.when(F.col("open"), "unclosed quote").when(F.col("text").rlike(r"\n[^\n]*[^ \t\n]"), "swallowed paragraph").when(welded, "welded prose")
    return d.select("chapter", "pos", kind.alias("kind")).where("kind is not null")


def split_speeches(text: Column) -> Column:
    """text with marks of their own for each paragraph of a speech that runs over an empty line."""
    spans = F.regexp_extract_all(text, F.lit(f"({SPAN})"), F.lit(1))
    each = F.transform(spans, lambda s: F.replace(s, F.lit("\n\n"), F.concat(F.right(s, F.lit(1)), F.lit("\n\n"), F.left(s, F.lit(1)))))
    return F.array_join(F.zip_with(F.split(text, SPAN, -1), each, lambda plain, s: F.concat(plain, F.coalesce(s, F.lit("")))), "")


def repair_verdicts(answers: DataFrame) -> DataFrame:
    """chapter, verdict of answers (chapter, body): what the body lacks, or whether the quote scan still faults its text."""
    text = F.get_json_object("json", "$.text")
    read = answers.select("chapter", repaired_json(F.col("body")).alias("json")).withColumn("text", split_speeches(text))
    faulty = quote_findings(read.where("trim(text) <> ''").select("chapter", "text")).select("chapter").distinct().withColumn("faulty", F.lit(True))
    shape = F.when(F.col("json").isNull(), "no json").when(F.col("text").isNull(), "no text").when(F.trim("text") == "", "empty")
    return read.join(faulty, "chapter", "left").select("chapter", F.coalesce(shape, F.when(F.col("faulty"), "faulty"), F.lit("accepted")).alias("verdict"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def attribution_audit(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """chapter, pos, kind of what is odd about who says a line. lines: chapter, pos, speaker, text; chapters: chapter, text.

    Each line is looked for in the chapter from where the line before was found; one that is not there is looked for from
    the chapter's start by its first 60 characters (20 at least). The share of quoted characters in the place found tells
    narration from speech. Both sides are compared with single spaces and without bracketed tags. A chapter's lines are
    folded in order; that is one chapter's array, not the table."""
    said = lines.withColumn("clean", squeezed(F.regexp_replace("text", r"\[[^\]]*\]", "")))
    named = F.lower("clean").startswith(F.lower("speaker"))
    rest = F.expr("substring(clean, length(speaker) + 1)")
    mention = (F.col("speaker") != "Narrator") & named & (F.substring(rest, 1, 1).isin("", " ")) & F.col("clean").isNotNull() & (F.regexp_replace(rest, "[ .,!…]+", "") != "")
    item = F.struct("pos", "speaker", "clean", F.coalesce(mention, F.lit(False)).alias("mention"), F.col("text").rlike('["“”]').alias("marked"))
    folded = said.groupBy("chapter").agg(F.array_sort(F.collect_list(item)).alias("items")).join(chapters.withColumnRenamed("text", "hay"), "chapter", "left")
    folded = folded.withColumn("hay", F.coalesce(squeezed(F.col("hay")), F.lit("")))
    runs = '["“「][^"”」]*(?:["”」]|\\z)'
    quoted = F.transform(F.regexp_extract_all("hay", F.lit(f"({runs})"), F.lit(1)), lambda q: F.repeat(F.lit("q"), F.length(q)))
    plain = F.transform(F.split("hay", runs, -1), lambda p: F.repeat(F.lit("n"), F.length(p)))
    folded = folded.withColumn("mask", F.array_join(F.zip_with(plain, quoted, lambda p, q: F.concat(p, F.coalesce(q, F.lit("")))), ""))
    find = lambda needle, start: F.when(needle == "", 0).otherwise(F.call_function("locate", needle, F.col("hay"), start))

    def step(acc: Column, x: Column) -> Column:
        whole, head = find(x["clean"], acc["cursor"]), F.substring(x["clean"], 1, 60)
        again = F.when(F.length(head) >= 20, find(head, F.lit(1))).otherwise(0)
        at = F.when(whole > 0, whole).otherwise(again)
        size = F.when(whole > 0, F.length(x["clean"])).otherwise(F.length(head))
        found = F.struct(x["pos"].alias("pos"), x["speaker"].alias("speaker"), x["mention"].alias("mention"), x["marked"].alias("marked"), at.alias("at"), size.alias("size"))
        return F.struct(F.when(at > 0, at).otherwise(acc["cursor"]).alias("cursor"), F.array_append(acc["out"], found).alias("out"))

    kind = "array<struct<pos:bigint,speaker:string,mention:boolean,marked:boolean,at:int,size:int>>"
    found = F.aggregate(F.transform("items", lambda x: x.withField("pos", x["pos"].cast("long"))), F.struct(F.lit(1).alias("cursor"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])
    placed = folded.select("chapter", "mask", F.explode(found).alias("x")).select("chapter", "x.*", F.expr("substring(mask, x.at, x.size)").alias("span"))
    share = F.length(F.translate("span", "n", "")) / F.greatest(F.length("span"), F.lit(1))
    told = F.when(F.col("at") == 0, "unmapped").when((F.col("speaker") != "Narrator") & (share < 0.5), "narration_spoken_by_character").when((F.col("speaker") == "Narrator") & (share > 0.95), "dialogue_spoken_by_narrator")
    kinds = F.array_compact(F.array(F.when(F.col("mention"), "mention"), F.when(F.col("marked"), "quote_marker_in_text"), told))
    return placed.select("chapter", "pos", F.explode(kinds).alias("kind"))


def speech_bursts(samples: Column, rate: int) -> Column:
    """Runs of speech in an array of samples: blocks of 10 ms whose root mean square is over BURST_LEVEL of the loudest."""
    hop = max(rate // 100, 1)
    blocks = F.floor(F.size(samples) / hop).cast("int")
    square = lambda i: F.aggregate(F.slice(samples, i * hop + 1, F.lit(hop)), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    levels = F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.sqrt(square(i) / hop))).otherwise(F.array().cast("array<double>"))
    loud = F.when(F.array_max(levels) > 1e-6, F.filter(F.transform(levels, lambda v, i: F.when(v > F.array_max(levels) * BURST_LEVEL, i)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    state = lambda first, last, n: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), n.cast("int").alias("n"))
    ended = lambda a: a["n"] + F.when(a["last"] - a["first"] + 1 >= BURST_LEAST, 1).otherwise(0)

    def step(a: Column, i: Column) -> Column:
        apart = i - a["last"] > BURST_GAP
        return state(F.when(a["first"].isNull() | apart, i).otherwise(a["first"]), i, F.when(apart, ended(a)).otherwise(a["n"]))

    none = F.lit(None).cast("int")
    return F.aggregate(loud, state(none, none, F.lit(0)), step, ended)


def babble(samples: Column, rate: int, phonemes: Column, cap_frames: Column, frames: Column) -> Column:
    """suspect, syllables, bursts of a generated chunk. Cues alone are suspect at the cap; with cues or without syllables
    nothing is judged; over MOST_SYLLABLES only the cap counts, and up to two syllables it counts besides the bursts."""
    cue = phonemes.contains("<|emotion_")
    alone = cue & ~strip_cues(phonemes).rlike(r"\p{L}")
    syllables = F.regexp_count(F.lower(strip_cues(phonemes)), F.lit(f"[{VOWELS}]+"))
    capped, bursts = frames >= F.greatest(cap_frames - 1, F.lit(0)), speech_bursts(samples, rate)
    counted = ~cue & (syllables > 0) & (syllables <= MOST_SYLLABLES)
    suspect = F.when(alone, capped).when(cue | (syllables == 0), F.lit(False)).when(syllables > MOST_SYLLABLES, capped).otherwise((bursts > syllables) | ((syllables <= 2) & capped))
    return F.struct(suspect.alias("suspect"), F.when(alone, 0).otherwise(syllables).alias("syllables"), F.when(counted, bursts).otherwise(0).alias("bursts"))
