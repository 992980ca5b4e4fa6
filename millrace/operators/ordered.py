"""Ordered work per key that stays bounded when one key holds most rows.

A window hands each key to one task. That is the best plan while every key is
small, so each function first asks for the size of the largest key (a two-column
aggregate with map-side combine). Beyond `limit` rows it takes the wide way:

* rows are range-partitioned on (keys, order), so a large key spreads over many
  partitions, and are written to the shared folder with their partition number
  (the "run"); a retried task can then never see other cuts;
* a per-run total gives each run its offset. Only a key that crosses a partition
  border needs one, so there are fewer offsets than partitions, at most `MAX_RUNS`,
  and they may be broadcast;
* the row-level window is then keyed by (keys, run).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.bounds import settle, width
from millrace.session import cut

GROUP_ROWS = 2_000_000
"""Largest group that is left to a single window task."""

ROW_BYTES = 128
"""Bytes that count as one row where wide columns ride along: `GROUP_ROWS` then stands for 256 MB."""

MAX_RUNS = 50_000
"""Most partitions of a range-partitioned table; beyond it they grow instead."""

_RUN, _RN, _BLOCK, _HOME = "__run", "__rn", "__block", "__home"


def group_extent(df: DataFrame, keys: Sequence[str], wide: Sequence[str] = ()) -> tuple[int, int]:
    """(rows in the largest group, rows in all). With `wide` columns, a row counts once for
    each `ROW_BYTES` that they hold."""
    if wide:
        rows = F.greatest(F.count(F.lit(1)), F.ceil(F.sum(width(df, list(wide))) / ROW_BYTES))
        row = df.groupBy(*keys).agg(rows.alias("n")).agg(F.max("n").alias("widest"), F.sum("n").alias("total")).first()
    elif keys:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        row = sizes.agg(F.max("n").alias("widest"), F.sum("n").alias("total")).first()
    else:
        row = df.agg(F.count(F.lit(1)).alias("widest"), F.count(F.lit(1)).alias("total")).first()
    return row["widest"] or 0, row["total"] or 0


def _runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], total: int, limit: int) -> DataFrame:
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(base, math.ceil(2 * total / limit)), MAX_RUNS)
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut(ranged.withColumn(_RUN, F.spark_partition_id()))


def _with_offsets(runs: DataFrame, keys: Sequence[str], totals: dict[str, Column], fold: dict[str, Callable]) -> DataFrame:
    """Attach, to every row, the totals of the earlier runs of its key (null in the first)."""
    per_run = runs.groupBy(*keys, _RUN).agg(*[c.alias(f"__t_{n}") for n, c in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(_RUN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(_RUN).alias("__k_run"),
        F.count(F.lit(1)).over(earlier).alias("__earlier"),
        *[fold[n](F.col(f"__t_{n}")).over(earlier).alias(f"__o_{n}") for n in totals],
    ).where("__earlier > 0")
    match = F.col(_RUN) == F.col("__k_run")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    offsets, few = settle(offsets, MAX_RUNS)
    joined = runs.join(F.broadcast(offsets) if few else offsets, match, "left")
    return joined.drop("__k_run", "__earlier", *[f"__k_{k}" for k in keys])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
    limit: int = GROUP_ROWS,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """Add the row number (from 1) of each row within its key. `order` must be total.

    Here and below a caller that knows the `group_extent` may hand it in.
    """
    widest, total = extent or group_extent(df, keys)
    if widest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    runs = _runs(df, keys, order, total, limit)
    rows = _with_offsets(runs, keys, {"n": F.count(F.lit(1))}, {"n": F.sum})
    w = Window.partitionBy(*keys, _RUN).orderBy(*order)
    number = F.row_number().over(w).cast("long") + F.coalesce("__o_n", F.lit(0))
    return rows.withColumn(name, number).drop(_RUN, "__o_n")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    limit: int = GROUP_ROWS,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """Add running sums and running maxima, current row included. `order` must be total."""
    sums, maxima = sums or {}, maxima or {}
    widest, total = extent or group_extent(df, keys)
    if widest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        added = {n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.max(c).over(w) for n, c in maxima.items()}
        return df.withColumns(added)
    runs = _runs(df, keys, order, total, limit)
    totals = {n: F.sum(c) for n, c in sums.items()} | {n: F.max(c) for n, c in maxima.items()}
    fold = {n: F.sum for n in sums} | {n: F.max for n in maxima}
    rows = _with_offsets(runs, keys, totals, fold)
    w = Window.partitionBy(*keys, _RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    added = {}
    for n, c in sums.items():
        own, before = F.sum(c).over(w), F.col(f"__o_{n}")
        added[n] = F.when(before.isNull(), own).when(own.isNull(), before).otherwise(own + before)
    for n, c in maxima.items():
        added[n] = F.greatest(F.max(c).over(w), F.col(f"__o_{n}"))
    return rows.withColumns(added).drop(_RUN, *[f"__o_{n}" for n in totals])


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    make: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    limit: int = GROUP_ROWS,
    extent: tuple[int, int] | None = None,
    wide: Sequence[str] = (),
) -> DataFrame:
    """Add window columns that look at most `back` rows back and `ahead` rows ahead.

    Name the columns that may hold long values in `wide`, so that groups are bounded by bytes.

    `make` receives the ordered window and names the new columns. In the wide way a
    key is cut into equal blocks by row number; rows near a border are also copied
    into the neighbouring block as context and dropped again after the window.
    """
    extent = extent or group_extent(df, keys, wide)
    if extent[0] <= limit:
        return df.withColumns(make(Window.partitionBy(*keys).orderBy(*order)))
    if wide:  # fewer rows to a block, as each is wider
        limit = max(1, limit * df.count() // max(extent[1], 1))
    size = max(limit, back, ahead)
    rows = numbered(df, keys, order, _RN, limit, extent)
    home, place = F.floor((F.col(_RN) - 1) / size), (F.col(_RN) - 1) % size
    blocks = F.array_compact(
        F.array(
            home,
            F.when(place >= size - back, home + 1) if back else F.lit(None).cast("long"),
            F.when(place < ahead, home - 1) if ahead else F.lit(None).cast("long"),
        )
    )
    copied = rows.withColumn(_HOME, home).withColumn(_BLOCK, F.explode(blocks))
    made = copied.withColumns(make(Window.partitionBy(*keys, _BLOCK).orderBy(_RN)))
    return made.where(F.col(_BLOCK) == F.col(_HOME)).drop(_RN, _BLOCK, _HOME)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first `k` rows of each key. `order` must be total. Each task keeps k rows a key before
    the shuffle, so a crowded key is no burden."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RN, place).where(F.col(_RN) <= k).drop(_RN)
