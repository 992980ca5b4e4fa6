"""Writers. Every task writes its own part files; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import file_key, in_one_line
from millrace.sources.tables import NULL_TEXT


def write_json_splits(df: DataFrame, folder: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy("split").json(folder)


def write_parquet_splits(df: DataFrame, folder: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy("split").parquet(folder)


def write_csv(df: DataFrame, folder: str, mode: str = "error", file_rows: int = 0) -> None:
    """CSV with a header; nested columns become JSON text, nulls a marker of their own.

    A line break inside a text is written as `\\n` or `\\r` and a backslash doubled, so a row is a line and
    a file can be read by many tasks. A file takes at most `file_rows` rows, if that is positive.
    """
    nested = (T.StructType, T.MapType, T.ArrayType)

    def flat(f: T.StructField) -> Column:
        name = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, nested):
            return in_one_line(F.to_json(name)).alias(f.name)
        return in_one_line(F.col(name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(name)

    (
        df.select(*map(flat, df.schema)).write.mode(mode).option("maxRecordsPerFile", file_rows).option("header", True).option("quoteAll", True)
        .option("quote", '"').option("escape", '"').option("nullValue", NULL_TEXT)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    )


def write_by_model(df: DataFrame, folder: str, model: str = "model", mode: str = "error") -> None:
    """One folder per model, named by a form of the model's name that fits a path."""
    df.withColumn("model_key", file_key(F.col(model))).write.mode(mode).partitionBy("model_key").json(folder)


def write_statistics(df: DataFrame, folder: str, mode: str = "error") -> None:
    df.write.mode(mode).json(folder)


def manifest(settings: dict, usage: DataFrame, quality: DataFrame, written_at: str) -> DataFrame:
    """One row: settings, usage, quality counters and the time. The one-row inputs come in
    as scalar subqueries."""
    spark = usage.sparkSession
    pairs = [c for k, v in settings.items() for c in (F.lit(k), F.lit(str(v)))]
    return spark.range(1).select(
        F.create_map(*pairs).alias("settings"),
        usage.select(F.struct("*")).scalar().alias("usage"),
        quality.select(F.struct("*")).scalar().alias("quality"),
        F.lit(written_at).alias("timestamp"),
    )


def write_report(lines: DataFrame, folder: str, mode: str = "error") -> None:
    """Report lines in order, over as many part files as their size asks for."""
    lines.orderBy("section", "group", "line_no").select("line").write.mode(mode).text(folder)
