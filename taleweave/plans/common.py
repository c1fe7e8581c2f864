"""Table access and SQL fragments that the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


S = r"[ \t\n\r\f\x0B]"


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+\z', '', 'g')"


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{S}+', ' ', 'g'), ' ')"


def pick(values, key: Column) -> Column:
    """One of the values for each row, by an integer key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) if isinstance(v, str) else "NULL" if v is None else repr(v) for v in values) + "]"


def sql_pick(values, key: str) -> str:
    return f"{sql_list(values)}[{key} % {len(values)} + 1]"
