"""Streaming jobs over a folder of event files.

State is always bounded: either a watermark drops it, or there is none. Output and
progress live in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.joins import meet
from millrace.session import fresh_folder
from millrace.sources.tables import from_records


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def append_to(stream: DataFrame, out: str, progress: str) -> None:
    """Write what is there to a folder, once, each row exactly once; then stop.

    Started again with the same folders it goes on where it stopped, so a snapshot
    only ever adds the new rows.
    """
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def count_batches(stream: DataFrame, by: list[Column], out: str, progress: str) -> None:
    """Counts per micro-batch, each batch under its own number.

    The counts of a batch do not depend on other batches, so no state is kept, and a
    batch that is run again replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def total_counts(spark: SparkSession, out: str, by: list[str], schema: str) -> DataFrame:
    """All batches of `count_batches` added up; no rows before the first batch. `schema`: of the
    `by` columns."""
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return from_records(spark, [], f"{schema}, n long")
    return spark.read.schema(f"{schema}, n long").parquet(out).groupBy(*by).agg(F.sum("n").alias("n"))


def sliding_totals(stream: DataFrame, ts: str, keys: list[str], tokens: Column, size: str = "60 seconds", step: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    """Requests and tokens per key and sliding window; a window is given out once it is
    older than the watermark."""
    return _windows(stream.withWatermark(ts, late), ts, keys, tokens, size, step)


def open_windows(
    rows: DataFrame, given_out: DataFrame, ts: str, keys: list[str], tokens: Column, size: str = "60 seconds", step: str = "10 seconds", late: str = "60 seconds"
) -> DataFrame:
    """The windows of a batch of events that a finished stream hasn't given out, as they were
    still open when it ended: those that end after the last time less `late`. Null keys count.

    One column is read for the last time; beyond that only events that such a window can hold.
    """
    ended = F.date_trunc("millisecond", F.max(ts)) - F.expr(f"interval {late}")
    first = rows.agg(F.unix_micros(ended - F.expr(f"interval {size}")).alias("us")).first()["us"]
    if first is None:
        return _windows(rows, ts, keys, tokens, size, step)
    young = rows.where(F.col(ts) > F.timestamp_micros(F.lit(first)))
    given = given_out.where(F.col("start_us") > first).select("start_us", *keys)
    return meet(_windows(young, ts, keys, tokens, size, step).where(F.col("start_us") > first), given, ["start_us", *keys], "left_anti")


def _windows(rows: DataFrame, ts: str, keys: list[str], tokens: Column, size: str, step: str) -> DataFrame:
    return (
        rows.groupBy(F.window(ts, size, step), *keys)
        .agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))
        .select(F.unix_micros("window.start").alias("start_us"), *keys, "requests", "tokens")
    )


def window_counts(stream: DataFrame, ts: str, keys: list[str], out: str, progress: str, size: str = "1 hour", late: str = "1 hour") -> None:
    """Counts per key and event-time window while rows arrive: each batch writes the windows it changed, with their new counts.

    A row that comes late corrects the count given out before, unless its window is older than the
    watermark, which also bounds the state. A batch that is run again replaces its own folder.
    """
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"))
    changed = counts.select(F.unix_micros("window.start").alias("start_us"), *keys, "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_counts(spark: SparkSession, out: str, keys: list[str], schema: str) -> DataFrame:
    """The newest count of each key and window of `window_counts`. `schema`: of the keys."""
    rows = spark.read.schema(f"start_us long, {schema}, n long, batch long").parquet(out)
    return rows.groupBy("start_us", *keys).agg(F.max_by("n", "batch").alias("n"))


def first_seen(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row per key within the watermark; older keys are forgotten."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_folder(stream: DataFrame, name: str) -> str:
    """Run a stream over what is there into a new shared folder and name the folder."""
    spark = stream.sparkSession
    root = fresh_folder(spark, name)
    append_to(stream, f"{root}/rows", f"{root}/progress")
    return f"{root}/rows"
