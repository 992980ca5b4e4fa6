"""Quotas: how many rows each stratum should get, and whether it can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import text_key
from millrace.operators.joins import meet

# Default shares in percent.
STYLE_SHARES = {"clean": 50, "documented": 30, "optimized": 20}

UNIT_CHUNK = 100_000


def _entries(shares: Mapping[str, float], name: str) -> Column:
    return F.array(*[F.struct(F.lit(k).alias(name), F.lit(float(v)).alias(f"{name}_pct")) for k, v in shares.items()])


def quota_grid(
    target: DataFrame,
    outer: Mapping[str, float],
    inner: Mapping[str, float],
    names: tuple[str, str] = ("language", "difficulty"),
    mode: str = "floor",
) -> DataFrame:
    """Quota per (outer, inner) pair for the one-row table `target(target)`.

    `floor` cuts off twice, so the sum may fall short. `largest_remainder` hands the
    missing units to the pairs that lost most. The grid is exploded from literals, so
    no join is needed.
    """
    a, b = names
    grid = (
        target.select("target", F.explode(_entries(outer, a)).alias("o"))
        .select("target", "o.*", F.explode(_entries(inner, b)).alias("i"))
        .select("target", a, f"{a}_pct", "i.*")
    )
    if mode == "floor":
        first = F.floor(F.col("target") * F.col(f"{a}_pct") / 100)
        return grid.select(a, b, F.floor(first * F.col(f"{b}_pct") / 100).cast("long").alias("quota"))
    exact = F.col("target") * F.col(f"{a}_pct") * F.col(f"{b}_pct") / 10_000
    parts = grid.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    everything, lost = Window.partitionBy("target"), F.col("exact") - F.col("base")
    parts = parts.withColumn("missing", F.round(F.sum("exact").over(everything)) - F.sum("base").over(everything))
    place = F.row_number().over(everything.orderBy(lost.desc(), a, b))
    return parts.select(a, b, (F.col("base") + F.when(place <= F.col("missing"), 1).otherwise(0)).cast("long").alias("quota"))


def quota_units(quotas: DataFrame, keys: Sequence[str], chunk: int = UNIT_CHUNK) -> DataFrame:
    """One row per unit of quota, numbered from 1. Large quotas are unrolled in two
    steps, so that no single row holds all its units."""
    chunks = F.when(F.col("quota") > 0, F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / chunk)))
    parted = quotas.select(*keys, "quota", F.explode(chunks).alias("__chunk"))
    parted = parted.repartition(*keys, "__chunk")
    start = F.col("__chunk") * chunk
    units = F.sequence(start + 1, F.least(start + chunk, F.col("quota")))
    return parted.select(*keys, F.explode(units).alias("unit"))


def total_quota(nested: DataFrame, column: str = "quotas") -> DataFrame:
    """Sum over a column that maps a label to a map of counts."""
    outer = nested.select(F.explode(F.map_values(column)).alias("inner"))
    return outer.select(F.explode(F.map_values("inner")).alias("n")).agg(F.sum("n").alias("total"))


def shortfall(rows: DataFrame, by: Sequence[str], quotas: DataFrame) -> DataFrame:
    """Quota, rows delivered and the gap, per stratum."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("delivered"))
    joined = meet(quotas.select(*by, "quota"), counts, by)
    delivered = F.coalesce("delivered", F.lit(0))
    return joined.select(*by, "quota", delivered.alias("delivered"), (F.col("quota") - delivered).alias("shortfall"))


def capacity(df: DataFrame, by: Sequence[str], text: str, quotas: DataFrame) -> DataFrame:
    """Distinct texts a stratum can give against its quota."""
    distinct = df.groupBy(*by).agg(F.count_distinct(text_key(F.col(text))).alias("capacity"))
    joined = meet(quotas.select(*by, "quota"), distinct, by)
    have = F.coalesce("capacity", F.lit(0))
    return joined.select(*by, "quota", have.alias("capacity"), (have >= F.col("quota")).alias("enough"))
