"""Registration, table access and the SQL fragments that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import SPACE_CODES
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL to check it against."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table. The naive event times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = table(spark, sf, name)
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def r6(c: Column) -> Column:
    return F.round(c, 6)


SPACE_SQL = "||".join(f"chr({c})" for c in SPACE_CODES)
SPACE_RUN_SQL = "[" + "".join(f"\\x{{{c:X}}}" for c in SPACE_CODES) + "]+"


def strip_sql(c: str) -> str:
    return f"trim({c}, {SPACE_SQL})"


def norm_sql(c: str) -> str:
    return strip_sql(f"lower({c})")


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{SPACE_RUN_SQL}'), lambda w: w <> '')"


def key_sql(row_id: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {row_id})"


def draw_sql(row_id: str, salt: str = "", seed: int = 42) -> str:
    tail = f" || ':{salt}'" if salt else ""
    return f"cast('0x' || substr(md5('{seed}:' || {row_id}{tail}), 1, 8) as bigint)"
