"""Chapter index: number to address over a dense range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def densify(listing: DataFrame, start: int, count: int, total: int | None = None) -> DataFrame:
    """n, url, absent for start .. start + count - 1 and every listed n; past `total` a chapter is absent."""
    wanted = listing.sparkSession.range(start, start + count).withColumnRenamed("id", "n")
    absent = F.col("n") > F.lit(total) if total is not None else F.lit(False)
    return wanted.join(listing, "n", "full_outer").select("n", F.when(~absent, F.col("url")).alias("url"), absent.alias("absent"))


def usable(size: Column, hand: Column, same: Column, start: Column, count: Column, want_start: Column, want_count: Column) -> Column:
    """A non-empty index that covers the range; one that was not written by hand must also have the same fingerprint."""
    covers = (start <= want_start) & (want_start + want_count <= start + count)
    return F.when(size == 0, False).when(hand, covers).otherwise(covers & same)


def numbered(rows: DataFrame, keys: list[str], cell: Column, order: list[str], name: str = "k") -> DataFrame:
    """rows with their number (from 1) within keys, in order. cell is a number that does not fall along the order: rows are
    numbered within cells, and the cells' sizes give the rest, so a key that holds the table is no single task."""
    own = F.row_number().over(W.partitionBy(*keys, "__cell").orderBy(*order))
    before = F.sum("__size").over(W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1))
    cells = rows.withColumn("__cell", cell)
    sizes = cells.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__size"))
    sizes = sizes.select(*keys, "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    return cells.withColumn("__own", own).join(sizes, [*keys, "__cell"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__cell", "__own", "__before")
