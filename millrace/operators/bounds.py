"""Whether a table is small enough to be sent to every executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut

BROADCAST_ROWS = 50_000
"""Largest table, in rows, that is sent to every executor."""

BROADCAST_BYTES = 16 << 20
"""Largest such table in bytes of its values."""


def width(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Bytes of the values of a row."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        if columns is not None and f.name not in columns:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            size = F.size(c) * 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def settle(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Compute `df` once, into the shared folder: (the written table, whether it is small).

    Small means at most `rows` rows and `size` bytes of values, as counted in the written
    table. Only these two numbers reach the driver.
    """
    written = cut(df)
    facts = written.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width(written)), F.lit(0)).alias("bytes")).first()
    return written, facts["n"] <= rows and facts["bytes"] <= size
