"""Statistics over the last rows of a series, norms and clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import squared_gap, squared_norm
from millrace.operators.joins import attach
from millrace.operators.ordered import GROUP_ROWS, framed


def recent_mean(
    df: DataFrame, keys: Sequence[str], order: list[Column], values: Sequence[str], n: int = 10, limit: int = GROUP_ROWS
) -> DataFrame:
    """Mean of the last `n` values of each series, the current row included, as `avg_<name>`."""

    def make(w):
        recent = w.rowsBetween(1 - n, 0)
        return {f"avg_{v}": F.avg(v).over(recent) for v in values}

    return framed(df, keys, order, make, back=n - 1, limit=limit)


def adaptive_clip(
    df: DataFrame,
    keys: Sequence[str],
    order: list[Column],
    value: str,
    n: int = 100,
    more_than: int = 10,
    factor: float = 2.0,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Clip to mean + factor * population deviation of the last `n` values.

    There is no threshold until more than `more_than` values are known.
    """

    def make(w):
        recent = w.rowsBetween(1 - n, 0)
        line = F.avg(value).over(recent) + factor * F.stddev_pop(value).over(recent)
        return {"threshold": F.when(F.count(value).over(recent) > more_than, line)}

    rows = framed(df, keys, order, make, back=n - 1, limit=limit)
    over = F.coalesce(F.col(value) > F.col("threshold"), F.lit(False))
    return rows.withColumns({"is_clipped": over, "clipped": F.when(over, F.col("threshold")).otherwise(F.col(value))})


def clip_magnitude(value: Column, bound: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(bound))), F.lit(-float(bound)))


def group_norm(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Length of each group's values taken as one vector."""
    return df.groupBy(*keys).agg(F.sqrt(F.sum(value * value)).alias("norm"))


def scale_to_norm(df: DataFrame, keys: Sequence[str], value: str, row_id: str, bound: float) -> DataFrame:
    """Shrink groups whose norm is above `bound` down to it. The norms are joined back;
    crowded groups are spread, not windowed. Rows with a null key are a group too."""
    norms = group_norm(df, keys, F.col(value))
    rows = attach(df, norms, keys, "inner", spread=[row_id])
    factor = F.least(F.lit(1.0), F.lit(float(bound)) / F.nullif(F.col("norm"), F.lit(0.0)))
    return rows.withColumn("scaled", F.col(value) * F.coalesce(factor, F.lit(1.0)))


def weighted_mean(
    df: DataFrame, keys: Sequence[str], value: Column, important: Column, ignored: Column, weight: float = 2.0
) -> DataFrame:
    """Sum of weighted values over the number of rows used (not the sum of weights). A row whose mask is null is used."""
    used = df.where(~F.coalesce(ignored, F.lit(False)))
    w = F.when(important, F.lit(weight)).otherwise(F.lit(1.0))
    return used.groupBy(*keys).agg(
        (F.sum(w * value) / F.count(F.lit(1))).alias("weighted_mean"), F.count(F.lit(1)).alias("rows_used")
    )


def elapsed(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, limit: int = GROUP_ROWS) -> DataFrame:
    """Seconds since the previous row of the key; null on the first."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("__t", micros)

    def make(w):
        return {"elapsed_s": (F.col("__t") - F.lag("__t").over(w)) / 1e6}

    return framed(rows, keys, [F.col("__t"), F.col(row_id)], make, back=1, limit=limit).drop("__t")


def age_weights(df: DataFrame, keys: Sequence[str], ts: str, half_life_seconds: float) -> DataFrame:
    """Weight every row by its age against the newest row of its key, as `weight`.

    A row that is `half_life_seconds` older than another counts half as much, and the weights of
    a key add up to one. Rows of one time share the weight; a row without a time has a null one.
    The newest time and the sum per key are aggregated map-side and joined back, so a crowded
    key is spread. The exponent is taken from the newest row, so nothing overflows.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    newest = df.groupBy(*keys).agg(F.max(seconds).alias("__newest"))
    rows = attach(df, newest, keys, spread=[ts])
    raw = F.pow(F.lit(0.5), (F.col("__newest") - seconds) / F.lit(float(half_life_seconds)))
    aged = rows.withColumn("__raw", raw).drop("__newest")
    totals = aged.groupBy(*keys).agg(F.sum("__raw").alias("__total"))
    return attach(aged, totals, keys, spread=[ts]).withColumn("weight", F.col("__raw") / F.col("__total")).drop("__raw", "__total")


def step_sizes(df: DataFrame, keys: Sequence[str], row_id: str, vector: str, limit: int = GROUP_ROWS) -> DataFrame:
    """Mean length of the step from one vector of a key to the next."""

    def make(w):
        return {"__before": F.lag(vector).over(w)}

    rows = framed(df.select(*keys, row_id, vector), keys, [F.col(row_id)], make, back=1, limit=limit, wide=[vector])
    step = F.sqrt(squared_gap(F.col(vector), F.col("__before")))
    return rows.where(F.col("__before").isNotNull()).groupBy(*keys).agg(
        F.avg(step).alias("mean_step"), F.count(F.lit(1)).alias("steps")
    )


def vector_norms(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Length of all vectors of a key taken as one long vector."""
    return df.groupBy(*keys).agg(F.sqrt(F.sum(squared_norm(F.col(vector)))).alias("norm"))


def divergence(df: DataFrame, label: str, target: DataFrame) -> DataFrame:
    """Kullback-Leibler divergence of observed label shares from `target(label, pct)`.

    Labels without a target share cannot be compared; their share is reported.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    compared = counts.join(target, "label", "left")
    n, q = F.col("n"), F.when(F.col("pct") > 0, F.col("pct") / 100)
    # sum of p ln(p/q) with p = n/N, written so that N is needed only at the end
    sums = compared.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(q.isNotNull(), n)).alias("targeted"),
        F.sum(n * (F.log(n) - F.log(q))).alias("weighted"),
    )
    total, targeted = F.col("total"), F.coalesce("targeted", F.lit(0))
    return sums.select(
        ((F.col("weighted") - targeted * F.log("total")) / total).alias("divergence"),
        ((total - targeted) / total).alias("untargeted_share"),
    )
