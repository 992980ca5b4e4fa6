"""Connected components of an edge table, by alternating large and small stars.

Each round points every vertex at the smallest id it has seen (Kiveris et al., 2014); the
number of rounds grows with the logarithm of the longest chain. Minima are aggregated
map-side, and edges meet their minimum in a shuffled join whose crowded keys adaptive
execution splits, so a hub with very many links stays spread. Every round is written to the
shared folder; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def _starred(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link every vertex's neighbours (large: the larger ones; small: the smaller ones) to its minimum."""
    if both_ways:
        edges = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    if both_ways:
        least = least.select("a", F.least("a", "m").alias("m"))
        met = edges.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return met.where("a <> b").distinct()
    met = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of `edges` (a, b) that isn't its component's smallest.

    The component is the smallest id that links reach. Edges may be repeated and point
    either way; loops and edges with a null end are left out. No edges give no rows.
    """
    kind = dict(edges.dtypes)["a"]
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, seen = cut(pairs), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return state.select(F.col("a").cast(kind).alias("id"), F.col("b").cast(kind).alias("component"))
        seen = mark
        state = cut(_starred(_starred(state, True), False))
