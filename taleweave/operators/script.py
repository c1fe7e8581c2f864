"""Scripts: ordered lines of a chapter and what is declared on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.functions import text as fn


def drop_headline(lines: DataFrame, chapter: str, pos: str) -> DataFrame:
    """Without the first line of a chapter if that is its headline."""
    first = F.row_number().over(W.partitionBy(chapter).orderBy(pos)) == 1
    return lines.withColumn("__first", first).where(~(F.col("__first") & fn.headline(F.col("text")))).drop("__first")


def alignment(want: Column, got: Column) -> Column:
    """same; slip, if the words differ only in marks and case; else changed."""
    folded = lambda words: F.transform(words, fn.fold)
    return F.when(want == got, "same").when(folded(want) == folded(got), "slip").otherwise("changed")


def seam(value: Column) -> tuple[Column, Column]:
    """What a sound field asks for: its kind (nothing, names, tags) and parts. A name of `none` fires nothing."""
    t = F.trim(value)
    parts = lambda x: F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    tags = t.startswith("tags:")
    kind = F.when(value.isNull(), "nothing").when(tags, "tags").otherwise("names")
    names = F.filter(parts(t), lambda p: F.lower(p) != "none")
    return kind, F.when(value.isNull(), F.array().cast("array<string>")).when(tags, parts(F.substring(t, 6, 1 << 30))).otherwise(names)
