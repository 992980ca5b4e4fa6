"""Exact order statistics of the seeded shuffle without a global sort.

To find the row of rank r, count rows per bucket of leading key digits (at most
65,536 buckets per stratum, combined map-side), find the one bucket that holds
rank r, and order only the rows of that bucket. The table is then labelled by
comparing each row with the cut: no row-level shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.draws import shuffle_key
from millrace.operators.bounds import settle
from millrace.operators.joins import attach, meet

BUCKET_DIGITS = 4
"""Hexadecimal digits of the key that make a bucket: 65,536 buckets."""


def _key(seed: int | str, row_id: str) -> Column:
    """The shuffle key; a missing id comes first, as the empty key."""
    return F.coalesce(shuffle_key(seed, F.col(row_id)), F.lit(""))


def _keyed(df: DataFrame, by: Sequence[str], row_id: str, seed: int | str) -> DataFrame:
    keyed = df.select(*by, F.col(row_id).alias("__id"), _key(seed, row_id).alias("__key"))
    return keyed.withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))


def _placed(inside: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row numbers within the few buckets that hold a cut."""
    return inside.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__key", "__id")))


def rank_cuts(df: DataFrame, by: Sequence[str], row_id: str, seed: int | str, ranks: DataFrame, small: bool) -> DataFrame:
    """Shuffle key and id of the row at the wanted rank of each stratum.

    `ranks` holds (by..., rank) and `small` says whether it may be broadcast. The result
    (by..., cut_key, cut_id) lacks the strata that have fewer rows. `row_id` must be unique.
    """
    keyed = _keyed(df, by, row_id, seed)
    counts = keyed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket"))
    buckets = counts.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - F.col("__n"))
    holds = (F.col("rank") > F.col("__before")) & (F.col("rank") <= F.col("__upto"))
    wanted = meet(buckets, ranks, by, "inner").where(holds)
    wanted = wanted.select(*by, "__bucket", (F.col("rank") - F.col("__before")).alias("__place"))
    # one row per stratum on the right, so the join only picks the buckets
    inside = meet(keyed, F.broadcast(wanted) if small else wanted, [*by, "__bucket"], "inner")
    found = _placed(inside, by).where("__rn = __place")
    return found.select(*by, F.col("__key").alias("cut_key"), F.col("__id").alias("cut_id"))


def not_after(seed: int | str, row_id: str, cut_key: Column, cut_id: Column) -> Column:
    """Whether a row comes no later than the cut row in the seeded shuffle."""
    key = _key(seed, row_id)
    return (key < cut_key) | ((key == cut_key) & F.coalesce(F.col(row_id) <= cut_id, F.lit(True)))


def take_quota(df: DataFrame, by: Sequence[str], quotas: DataFrame, row_id: str, seed: int | str = 42) -> DataFrame:
    """Keep, per stratum, the first `quota` rows of the seeded shuffle.

    A stratum without a quota gives nothing; one with fewer rows gives all it has. A null
    stratum is a stratum like any other.
    """
    ranks, small = settle(quotas.where("quota > 0").select(*by, F.col("quota").cast("long").alias("rank")))
    limits = meet(ranks, rank_cuts(df, by, row_id, seed, ranks, small), by).drop("rank")
    if small:  # as many rows as the quotas have, and of bounded width
        rows = meet(df, F.broadcast(limits), by, "inner")
    else:
        rows = attach(df, limits, by, "inner", spread=[row_id])
    keep = F.col("cut_key").isNull() | not_after(seed, row_id, F.col("cut_key"), F.col("cut_id"))
    return rows.where(keep).drop("cut_key", "cut_id")


def split_column(
    ids: DataFrame,
    row_id: str,
    shares: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)),
    seed: int | str = 42,
) -> Column:
    """Column that names the part of a row, for tables with the same ids.

    Sizes are floor(n * share); the last part takes the rest. `row_id` must be unique, one null
    included. Two passes over the ids
    find the cuts (65,536 counts and a handful of rows reach the driver, whatever the
    size of the table); the column is then a plain comparison.
    """
    keyed = _keyed(ids, [], row_id, seed)
    counts = dict(keyed.groupBy("__bucket").agg(F.count(F.lit(1))).collect())
    total, upto, ranks = sum(counts.values()), 0, {}
    for name, share in shares[:-1]:
        upto += int(total * share)
        if upto:
            ranks[name] = upto
    places, before = {}, 0
    for bucket in sorted(counts):
        places |= {n: (bucket, r - before) for n, r in ranks.items() if before < r <= before + counts[bucket]}
        before += counts[bucket]
    label = F.lit(shares[-1][0])
    if places:
        inside = _placed(keyed.where(F.col("__bucket").isin([b for b, _ in places.values()])), [])
        wanted = reduce(or_, [(F.col("__bucket") == b) & (F.col("__rn") == p) for b, p in places.values()])
        found = {(r["__bucket"], r["__rn"]): r for r in inside.where(wanted).collect()}
        for name in reversed(places):
            row = found[places[name]]
            hit = not_after(seed, row_id, F.lit(row["__key"]), F.lit(row["__id"]) if row["__id"] is not None else F.lit(None))
            label = F.when(hit, F.lit(name)).otherwise(label)
    return label


def exact_split(
    df: DataFrame,
    row_id: str,
    shares: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)),
    seed: int | str = 42,
    column: str = "split",
) -> DataFrame:
    """Label each row of `df` with its part.

    `df` is read three times, twice for its ids alone; give a costly one to `cut` first.
    """
    return df.withColumn(column, split_column(df, row_id, shares, seed))
