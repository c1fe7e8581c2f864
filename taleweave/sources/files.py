"""Readers and writers for chapters, documents, registries, ledgers and subtitles.

Everything goes through Spark's own file sources, so any store that Spark reaches works and the commit protocol of the
writers replaces temporary siblings and renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATS = "stage string, units long, secs double, ts long, worker string"
SOUND = "struct<tags:array<string>,files:array<string>,looped:boolean,dur_s:double,mode:string,hold:double,level:double,id:string>"
VOICE = "struct<file:string,tags:array<string>,label:string,exclusive:boolean>"


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """n, text: one file per chapter, numbered by the digits of its name."""
    from taleweave.functions.text import number_in_name

    name = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -1)
    return spark.read.text(path, wholetext=True).select(number_in_name(name).alias("n"), F.col("value").alias("text")).where("n > 0")


def documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row per JSON document, whatever its line breaks."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """Measurements as JSON lines; blank and broken lines are dropped."""
    return spark.read.schema(STATS).option("mode", "DROPMALFORMED").json(path).where("stage is not null")


def append_stats(rows: DataFrame, path: str) -> None:
    rows.select("stage", F.greatest("units", F.lit(1)).alias("units"), "secs", "ts", "worker").write.mode("append").json(path)


def registry(spark: SparkSession, path: str, kind: str = SOUND) -> DataFrame:
    """name and fields of each entry of a JSON map; an unreadable file has none."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.map_entries(F.from_json("value", f"map<string,{kind}>"))).alias("e"))
    return entries.select(F.col("e.key").alias("name"), "e.value.*")


def scene_rules(spark: SparkSession, path: str) -> DataFrame:
    """pos, match, effect, level, reverb, pause_before_s: the rules of a scene map in their order."""
    kind = "struct<rules:array<struct<match:array<string>,effect:array<string>,level:double,reverb:string,pause_before_s:double>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return text.select(F.posexplode("m.rules").alias("pos", "r")).select("pos", "r.*")


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Task rows; what this version cannot parse is kept word for word in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def migrated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An old ledger (task columns, machine, config, state): its tasks, and the machines' configuration by itself."""
    machines = rows.where("machine is not null").groupBy("machine").agg(F.max_by("config", "updated").alias("config"))
    return rows.drop("config"), machines


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """chapter, engine, name, bytes, sha of files under <chapter>/<engine>/, sorted."""
    parts = F.split(F.regexp_replace("path", r"\?.*$", ""), "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.select(F.element_at(parts, -3).alias("chapter"), F.element_at(parts, -2).alias("engine"), F.element_at(parts, -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"))
    return out.orderBy("chapter", "engine", "name")


def decoded(pages: DataFrame) -> DataFrame:
    """pages (content, content_type) with text: as UTF-8 if it is that, else by the header's or the document's charset."""
    plain, single = F.decode("content", "UTF-8"), F.decode("content", "ISO-8859-1")
    named = F.lower(F.coalesce(F.nullif(F.regexp_extract("content_type", r"(?i)charset=[\"']?([a-z0-9_-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(single, r"(?i)<meta[^>]{0,200}charset=[\"']?([a-z0-9_-]+)", 1), F.lit(""))))
    wide = F.when(named.isin("utf-16", "utf-16le"), F.decode("content", "UTF-16LE")).when(named == "utf-16be", F.decode("content", "UTF-16BE"))
    return pages.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), plain).otherwise(F.coalesce(wide, single)))


def importable(inputs: DataFrame, digested: DataFrame, least: int = 200) -> DataFrame:
    """inputs (n, text) with the reason why the import of all of them would be refused, null for a sound one."""
    known = digested.select("n").distinct().withColumn("done", F.lit(True))
    fault = F.when(F.coalesce(F.col("n"), F.lit(0)) <= 0, "no number").when(F.octet_length("text") < least, "too short").when(F.col("done"), "digested already")
    return inputs.join(known, "n", "left").select(*inputs.columns, fault.alias("fault"))


def changed(stamps: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of stamps (path, stamp) that are new or differ from before: what a cached view has to build again."""
    return stamps.join(before.select("path", "stamp"), ["path", "stamp"], "left_anti")


def quota_today(quota: DataFrame, today: str) -> DataFrame:
    return quota.where(F.col("date") == today)


def subtitles(captions: DataFrame, vtt: bool = False) -> DataFrame:
    """chapter, body: captions (chapter, pos, start, end in ms, text) as one SRT or VTT text per chapter."""
    from taleweave.functions.numbers import timestamp

    mark = "." if vtt else ","
    k = F.row_number().over(W.partitionBy("chapter").orderBy("start", "pos"))
    cue = F.concat_ws("\n", *([] if vtt else [F.col("k").cast("string")]), F.concat(timestamp(F.col("start"), mark), F.lit(" --> "), timestamp(F.col("end"), mark)), F.col("text"))
    cues = captions.withColumn("k", k).select("chapter", F.struct("k", cue.alias("cue")).alias("c"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cue"]), "\n\n")
    return cues.groupBy("chapter").agg(F.concat(F.lit("WEBVTT\n\n" if vtt else ""), body, F.lit("\n")).alias("body"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def book_ranges(items: DataFrame) -> DataFrame:
    """book, text: the entries (book, pos, text) of a book in order, page-split paragraphs rejoined."""
    from taleweave.functions.text import page_continues

    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("text")))), lambda x: x["text"])

    def join(so_far, x):
        glue = F.when(so_far == "", "").when(so_far.endswith("-"), "").when(page_continues(F.element_at(F.split(so_far, "\n"), -1), x), " ").otherwise("\n\n")
        return F.concat(F.when(so_far.endswith("-"), F.substring(so_far, F.lit(1), F.length(so_far) - 1)).otherwise(so_far), glue, x)

    return items.groupBy("book").agg(F.aggregate(parts, F.lit(""), join).alias("text"))
