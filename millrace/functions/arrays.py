"""Array columns: fixed-width sequences, masks and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label that marks a position to be left out.
IGNORED = -100


def fit_length(tokens: Column, width: int, pad: str) -> Column:
    """Cut to `width`, or fill up with `pad`."""
    kept = F.slice(tokens, 1, width)
    return F.concat(kept, F.array_repeat(F.lit(pad), width - F.size(kept)))


def presence_mask(tokens: Column, width: int) -> Column:
    """1 for a real token, 0 for filling."""
    real = F.least(F.size(tokens), F.lit(width))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), width - real))


def mask_first(values: Column, n: Column, mark: int = IGNORED) -> Column:
    """Replace the first `n` values by `mark`."""
    return F.transform(values, lambda x, i: F.when(i < n, F.lit(mark)).otherwise(x))


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return _total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def squared_gap(a: Column, b: Column) -> Column:
    """Sum of squared differences over the shorter of the two vectors."""
    n = F.least(F.size(a), F.size(b))
    gap = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") - y.cast("double"))
    return _total(F.transform(gap, lambda d: d * d))


def mean_squared_gap(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, squared_gap(a, b) / n)
