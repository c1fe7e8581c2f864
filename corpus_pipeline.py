"""From raw documents to encoded, mixed training text: quality rules, near-duplicates, mixing, sentence pieces.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and reads again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.llm import mixing, near_dup, piece_fst, quality
from taleweave.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept. Null and empty texts have no words and go; very long texts are judged whole; null
    language and source are groups of their own; repeated rows get equal verdicts. All columns stay, whatever their names;
    an empty table gives an empty one."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), that of the least doc_id. Texts without words
    and rows without doc_id have no copies and stay; exact repeats of a row become one; rows that repeat a doc_id with
    another text are judged by that text; very long texts are compared whole. All columns stay; an empty table gives an
    empty one."""
    return near_dup.without_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Null and empty texts have size 0; the null source is a source of its
    own; repeated rows count one by one. All columns stay, whatever their names; an empty table gives an empty one."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row of the mix, with their count and whether they decode to the text. Null and empty texts have no
    pieces; very long texts are encoded whole; repeated rows give repeated rows; other columns than doc_id and text go; an
    empty table gives no rows."""
    return piece_fst.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("mixing", mixture), ("sentence pieces", pieces)]

#: SQL expresses neither the estimates of the first stage nor the pieces of the last; tests hold run() to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
