"""Finding pages by following links: a frontier with a visited set, and walks along paginated listings.

Both run in rounds over tables in the shared folder; a round joins what is new with the links by address, takes away what
was visited by an anti-join, and appends the rest. A round costs its new pages and their links. Nothing is fetched: links
and pages are tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.scratch import fresh_path

SALTS = 32


def _first(rows: DataFrame, budget: int, taken: DataFrame) -> DataFrame:
    """The rows of each host, by address, that its budget leaves room for. taken: host, taken. A busy host's rows are cut to
    the budget in SALTS parts before they meet."""
    salt = F.pmod(F.xxhash64("url"), F.lit(SALTS))
    part = F.row_number().over(W.partitionBy("host", salt).orderBy("url"))
    few = rows.withColumn("at", part).where(F.col("at") <= budget)
    few = few.withColumn("at", F.row_number().over(W.partitionBy("host").orderBy("url"))).where(F.col("at") <= budget)
    return few.join(taken, "host", "left").where(F.col("at") <= budget - F.coalesce("taken", F.lit(0))).select("url", "host", "round")


def reachable(pages: DataFrame, links: DataFrame, entries: DataFrame, budget: int | None = None, most_rounds: int = 1_000) -> DataFrame:
    """url, host and round (0 for entries) of every page that the entries lead to, each once. pages: url, host; links: url,
    to; entries: url. With a budget a host gives no more pages than that, the first by (round, url); pages beyond it are
    not followed. Links to unknown pages lead nowhere; a null host is a host of its own."""
    spark, path = pages.sparkSession, fresh_path(pages.sparkSession, "visited")
    pages = pages.select("url", F.coalesce("host", F.lit("")).alias("host")).dropDuplicates(["url"])
    links = links.select("url", "to").where("url <> to").distinct()
    kind = "url string, host string, round int"
    spark.createDataFrame([], kind).write.parquet(path)
    step = entries.select("url").distinct()
    for turn in range(most_rounds):
        visited = spark.read.schema(kind).parquet(path)
        new = step.join(pages, "url").join(visited.select("url"), "url", "left_anti").select("url", "host", F.lit(turn).alias("round"))
        if budget is not None:
            new = _first(new, budget, visited.groupBy("host").agg(F.count(F.lit(1)).alias("taken")))
        new.write.mode("append").parquet(path)
        last = spark.read.schema(kind).parquet(path).where(F.col("round") == turn)
        if last.isEmpty():
            break
        step = last.join(links, "url").select(F.col("to").alias("url")).distinct()
    return spark.read.schema(kind).parquet(path)


def walked(entries: DataFrame, nexts: DataFrame, most: int = 60) -> DataFrame:
    """site, url, turn: the pages of each site's listing, from its entry along the next links until there is none, one comes
    back to a page of the walk, or there are `most`. entries: site, url (one a site); nexts: url, next (one a page)."""
    spark, path = entries.sparkSession, fresh_path(entries.sparkSession, "walked")
    kind = "site string, url string, turn int"
    entries.select("site", "url", F.lit(0).alias("turn")).where("url is not null").write.parquet(path)
    nexts = nexts.select("url", "next").where("next is not null").dropDuplicates(["url"])
    for turn in range(1, most):
        visited = spark.read.schema(kind).parquet(path)
        ahead = visited.where(F.col("turn") == turn - 1).join(nexts, "url").select("site", F.col("next").alias("url"), F.lit(turn).alias("turn"))
        ahead.join(visited.select("site", "url"), ["site", "url"], "left_anti").write.mode("append").parquet(path)
        if spark.read.schema(kind).parquet(path).where(F.col("turn") == turn).isEmpty():
            break
    return spark.read.schema(kind).parquet(path)


def chapters(walk: DataFrame, links: DataFrame) -> DataFrame:
    """site, n, url, title and total (the site's largest n) of the chapters that a walk's pages list: an address counts where
    it stands first; addresses without a number are no chapters. links: url (of the page), pos, to, title, n."""
    met = walk.join(links, "url").where("to <> ''")
    first = met.groupBy("site", "to").agg(F.min_by(F.struct("n", "title"), F.struct("turn", "pos")).alias("x")).where("x.n is not null")
    found = first.select("site", F.col("x.n").alias("n"), F.col("to").alias("url"), F.col("x.title").alias("title"))
    return found.join(found.groupBy("site").agg(F.max("n").alias("total")), "site")


def trailing_number(url: Column) -> Column:
    """The last run of digits of an address, as sites number their chapters; null without one."""
    digits = F.regexp_extract(url, r"(\d+)\D*$", 1)
    return F.when(digits != "", digits.try_cast("long"))
