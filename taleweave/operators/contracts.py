"""Contracts of scripts: each operator returns the rows that break a rule.

lines: chapter, pos, speaker, kind (narration, dialogue, thought), text. roster: chapter, name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NARRATOR, ANONYMOUS = "Narrator", "Anonymous"


def attribution(lines: DataFrame, roster: DataFrame) -> DataFrame:
    """chapter, pos, fault: a line without speaker, narration that is not the narrator's, speech that is, a speaker who is
    not on the chapter's roster."""
    known = roster.select("chapter", F.col("name").alias("speaker"), F.lit(True).alias("listed"))
    met = lines.join(known, ["chapter", "speaker"], "left")
    fault = (
        F.when(F.coalesce(F.trim("speaker"), F.lit("")) == "", "dropped").when((F.col("kind") == "narration") & (F.col("speaker") != NARRATOR), "narration")
        .when((F.col("kind") != "narration") & (F.col("speaker") == NARRATOR), "speech").when(F.col("listed").isNull(), "not listed")
    )
    return met.select("chapter", "pos", fault.alias("fault")).where("fault is not null")


def identity(roster: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """chapter, name, fault: roster names that are neither known characters, nor new ones of the chapter, nor reserved; and
    new characters under a reserved name."""
    named = roster.join(known, "name", "left_anti").join(new, ["chapter", "name"], "left_anti")
    strangers = named.where(~F.col("name").isin(NARRATOR, ANONYMOUS)).select("chapter", "name", F.lit("unknown").alias("fault"))
    return strangers.union(new.where(F.col("name").isin(NARRATOR, ANONYMOUS)).select("chapter", "name", F.lit("reserved")))


def unused_anonymous(roster: DataFrame, lines: DataFrame) -> DataFrame:
    return roster.where(F.col("name") == ANONYMOUS).join(lines.select("chapter", F.col("speaker").alias("name")), ["chapter", "name"], "left_anti")


def script(lines: DataFrame, known: DataFrame) -> DataFrame:
    """chapter, pos, fault: empty text, an unknown speaker, or the text of the line before by the same speaker."""
    order = W.partitionBy("chapter").orderBy("pos")
    again = (F.lag("text").over(order) == F.col("text")) & (F.lag("speaker").over(order) == F.col("speaker"))
    met = lines.withColumn("again", again).join(known.select(F.col("name").alias("speaker"), F.lit(True).alias("there")), "speaker", "left")
    fault = F.when(F.trim("text") == "", "empty").when(F.col("there").isNull(), "unknown speaker").when(F.col("again"), "repeated")
    return met.select("chapter", "pos", fault.alias("fault")).where("fault is not null")


def music(lines: DataFrame, palette: list[str]) -> DataFrame:
    """If any line of a chapter declares music, all must, each from the palette."""
    declared = F.bool_or(F.trim("music") != "").over(W.partitionBy("chapter"))
    m = F.trim("music")
    fault = F.when(m == "", "missing").when(~m.isin(*palette), "not in the palette")
    return lines.withColumn("declared", declared).where("declared").select("chapter", "pos", fault.alias("fault")).where("fault is not null")


def injects(items: DataFrame, pool: DataFrame) -> DataFrame:
    """items: chapter, pos, sound, stop, text. Faults: two directives on one item, text next to one, no line before, a sound
    the pool lacks, a stop without an earlier start."""
    order = W.partitionBy("chapter").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    heard = W.partitionBy("chapter", "name").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    own = items.withColumns({"before": F.coalesce(F.bool_or(F.col("text").isNotNull()).over(order), F.lit(False)), "name": F.coalesce("sound", "stop")})
    own = own.withColumn("started", F.coalesce(F.bool_or(F.col("sound").isNotNull()).over(heard), F.lit(False)))
    met = own.where("name is not null").join(pool.select("name", F.lit(True).alias("there")), "name", "left")
    fault = (
        F.when(F.col("sound").isNotNull() & F.col("stop").isNotNull(), "two directives").when(F.col("text").isNotNull(), "with text").when(~F.col("before"), "nothing before")
        .when(F.col("there").isNull(), "unknown sound").when(F.col("stop").isNotNull() & ~F.col("started"), "nothing to stop")
    )
    return met.select("chapter", "pos", fault.alias("fault")).where("fault is not null")
