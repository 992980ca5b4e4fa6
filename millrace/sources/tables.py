"""Readers. Every reader is given its schema; none infers one."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.text import in_lines

CORRUPT = "_corrupt_record"
NULL_TEXT = "\\N"
"""How a null is written in CSV, where it must differ from an empty text."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_rows(df: DataFrame, order: str, n: int = 1000) -> DataFrame:
    """The first rows by an explicit order."""
    return df.orderBy(order).limit(n)


def from_records(spark: SparkSession, records: Iterable, schema: T.StructType | str) -> DataFrame:
    """A table from rows in memory; an empty list keeps the schema.

    The rows go over as one Arrow table, which the optimizer sees with its true size.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = [dict(zip(schema.names, r)) if isinstance(r, (tuple, list)) else r for r in records]
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    hits = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(h.getPath().toString() for h in hits or [])


def read_json_splits(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a folder, with the split each row belongs to.

    The split is any `split=` folder or the name of any `.jsonl` file. Blank lines are
    dropped; a line that is no JSON is kept in `_corrupt_record`. A folder that holds neither
    is an error.
    """
    with_bad = T.StructType([*[f for f in schema if f.name != "split"], T.StructField(CORRUPT, T.StringType())])
    if _found(spark, f"{folder}/split=*"):
        return spark.read.schema(T.StructType([*with_bad, T.StructField("split", T.StringType())])).json(folder)
    if not _found(spark, f"{folder}/*.jsonl"):
        raise FileNotFoundError(f"no split= folders and no .jsonl files in {folder}")
    rows = spark.read.schema(with_bad).json(f"{folder}/*.jsonl")
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1))
    return rows.withColumn("split", name)


def read_splits(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Parquet when the folder holds it, JSON lines otherwise; the same columns either way.

    Parquet files without a `split=` folder have a null split. A line that is no JSON is an
    error when the rows are read, as is a folder without any such file at once.
    """
    columns = [f.name for f in schema if f.name != "split"]
    if _found(spark, f"{folder}/*.parquet"):
        return spark.read.schema(T.StructType([f for f in schema if f.name != "split"])).parquet(folder).withColumn("split", F.lit(None).cast("string"))
    if _found(spark, f"{folder}/split=*/*.parquet"):
        full = T.StructType([*[f for f in schema if f.name != "split"], T.StructField("split", T.StringType())])
        return spark.read.schema(full).parquet(folder).select(*columns, "split")
    rows = read_json_splits(spark, folder, schema)
    bad = F.raise_error(F.concat(F.lit("no JSON: "), F.col(CORRUPT)))
    checked = rows.withColumn("split", F.when(F.col(CORRUPT).isNull(), F.col("split")).otherwise(bad.cast("string")))
    return checked.select(*columns, "split")


def read_csv(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """CSV as `write_csv` leaves it: quoted, a row a line, line breaks in texts undone. Large files are read by several tasks."""
    rows = (
        spark.read.schema(schema).option("header", True)
        .option("quote", '"').option("escape", '"').option("nullValue", NULL_TEXT).option("emptyValue", "")
        .option("lineSep", "\n").csv(folder)
    )
    names = {f.name: "`" + f.name.replace("`", "``") + "`" for f in schema}
    return rows.select(*[(in_lines(F.col(names[f.name])) if isinstance(f.dataType, T.StringType) else F.col(names[f.name])).alias(f.name) for f in schema])
