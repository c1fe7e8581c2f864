"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. The documents of a source are
put in a fixed order, the expected copies are summed along it from one random offset, and a document is emitted once for
each integer boundary that its share of the sum crosses. The order goes by size class first, so that every size class
gives its share of words and the words taken lie near the target.

Cases: null text has size 0; the null source is a source of its own, last in order; a source whose documents are all
empty has target 0 and takes nothing; repeated rows count one by one; an empty table gives no rows; extra columns are
ignored; very long texts count with their whole size. Rows of one size and doc_id are told apart by nothing, so which of
them is taken more often is not fixed. The offset depends on the seed and the source name alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.scratch import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """Words to take from each source: source, source_size, docs, target, offset.

    sizes has source, size. Sources in code point order, null last, weigh weights over and over. A target stops at
    `most` times its source's size, and what is cut off is shared again by weight. That has a closed form: with the
    sources ordered by size / weight, the capped ones come first, and the first cut at which the common level of the
    rest is within their own caps is the answer. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    levels = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn(
        "weight", F.element_at(levels, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everyone = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = everyone.rowsBetween(W.unboundedPreceding, -1)
    onward = everyone.rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    common = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)
    per = per.withColumn("common", common.getField("level"))
    capped = F.col("common").isNull() | (F.col("common") * F.col("weight") > F.col("cap"))
    return per.select(
        "source", "source_size", "docs", F.when(capped, F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target")
    )


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, from 16 bits of a digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("long") / F.lit(65536.0)


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null meeting null; the columns of right besides keys are added."""
    other = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(other[f"__{c}"]) for c in keys]
    return left.join(other, on).drop(*[f"__{c}" for c in keys])


def mix(documents: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    The place of a document within its source comes from counts of cells (source, size class, two hex digits of a
    digest of doc_id) and a row number inside the cell, so no task sorts a whole source, whatever its share of the rows.
    """
    slim = written(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    bits = F.bin(F.col("size"))
    slim = slim.withColumn("band", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 5)))
    slim = slim.withColumn("salt", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2))
    keys = ["source", "band", "salt"]
    cells = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    in_band = W.partitionBy("source", "band").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    in_source = W.partitionBy("source").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("n").over(in_band), zero))
    bands = cells.groupBy("source", "band").agg(F.sum("n").alias("n")).withColumn("band_start", F.coalesce(F.sum("n").over(in_source), zero))
    targets = source_targets(cells.select("source", "size"), weights, share, most).drop("docs")

    cells = _meet(cells.drop("n", "size"), bands.drop("n"), ["source", "band"])
    cells = _meet(cells, targets, ["source"]).withColumn("start", F.col("cell_start") + F.col("band_start"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("size", "doc_id"))
    docs = slim.withColumn("place", place)
    docs = _meet(docs, cells, keys).withColumn("rank", F.col("place") + F.col("start"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    first = offset(F.col("source"), seed)
    copies = (F.floor(F.col("rank") * rate + first) - F.floor((F.col("rank") - 1) * rate + first)).cast("long")
    return docs.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(documents: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 7) -> DataFrame:
    """The rows of documents, each as often as the mix takes it; columns as in documents, whatever their names.

    Rows are numbered in a written copy, so rows that share a doc_id get copies of their own.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    numbered = written(documents.select(row, F.monotonically_increasing_id().alias("number")), "mix-rows")
    keys = numbered.select(F.col("number").alias("doc_id"), "row.source", "row.text")
    copies = mix(keys, weights, share, most, seed).where("copies > 0").select(F.col("doc_id").alias("number"), "copies")
    out = numbered.join(copies, "number")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
