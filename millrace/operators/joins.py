"""Joins of many rows to a table that has one row per key. A null key is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.bounds import BROADCAST_ROWS, settle
from millrace.operators.ordered import GROUP_ROWS, group_extent

CROWDED_KEYS = 50_000
"""Most keys that are treated as crowded: each holds more than this share of the rows."""


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys of which null equals null. A full outer join takes the key from either side."""
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") if k in keys else F.col(k) for k in right.columns])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = left.join(renamed, match, how)
    if how in ("left_anti", "left_semi"):
        return joined
    if how == "full_outer":  # an absent side has null keys, so where they differ the other side's counts
        joined = joined.withColumns({k: F.coalesce(k, f"__k_{k}") for k in keys})
    return joined.drop(*[f"__k_{k}" for k in keys])


def attach(
    df: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread: Sequence[str] = (),
    small: int = BROADCAST_ROWS,
    hot: int = GROUP_ROWS,
) -> DataFrame:
    """Join `dim`, unique on `keys`, to `df`; null keys meet.

    A lookup of proven size is broadcast. A larger one is shuffled; a key (null as well) with
    more than `hot` rows on the left is then spread, by the hash of the `spread` columns (all
    columns when none are named), over as many copies of its one lookup row as it has
    multiples of `hot`. At most `CROWDED_KEYS` keys can be that large; they are broadcast if
    their values are small.
    """
    dim, is_small = settle(dim, small)
    if is_small:
        return meet(df, F.broadcast(dim), keys, how)
    widest, total = group_extent(df, keys)
    if widest <= hot:
        return meet(df, dim, keys, how)
    hot = max(hot, total // CROWDED_KEYS)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot)
    crowded, few = settle(sizes.select(*keys, F.ceil(F.col("__n") / hot).cast("int").alias("__copies")), CROWDED_KEYS)
    crowded = F.broadcast(crowded) if few else crowded
    copies = F.coalesce("__copies", F.lit(1))
    salt = F.pmod(F.xxhash64(*(spread or df.columns)), copies.cast("long")).cast("int")
    left = meet(df, crowded, keys).withColumn("__salt", salt).drop("__copies")
    right = meet(dim, crowded, keys).withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return meet(left, right.drop("__copies"), [*keys, "__salt"], how).drop("__salt")
