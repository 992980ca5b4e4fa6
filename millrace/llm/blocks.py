"""Groups of any size, cut into cells that hold every pair of their rows once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_ROWS = 128
"""Rows of a group that stay together. A larger group is dealt into blocks, a cell for each two blocks."""


def paired_cells(df: DataFrame, keys: list[str], row_id: str, rows: int = CELL_ROWS) -> DataFrame:
    """Drop groups of one row and add `cell_a`, `cell_b` and `block` to the rows of the others.

    A group of n rows is dealt by the digest of `row_id` into blocks of about
    max(rows, 3 * sqrt(n)) rows. The cell (a, a) holds block a; the cell (a, b), a < b, holds
    both, and only pairs between them are to be met there. Sizes are aggregated map-side and
    joined back by a shuffle whose crowded keys adaptive execution splits. Rows with a null
    key are in no group.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / F.greatest(F.lit(rows), F.ceil(3 * F.sqrt("__n")))).cast("int")
    own = df.join(sizes, keys).withColumn("__blocks", blocks)
    own = own.withColumn("block", F.pmod(F.xxhash64(row_id), F.col("__blocks")).cast("int"))
    every = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    cells = every.withColumn("cell_a", F.least("block", "__other")).withColumn("cell_b", F.greatest("block", "__other"))
    return cells.drop("__n", "__blocks", "__other")


class Sets:
    """Union-find over the rows of a cell."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
