"""Repeatable random draws: every choice is a function of a seed and an id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int | str, row_id: Column, salt: str = "") -> Column:
    tail = [F.lit(f":{salt}")] if salt else []
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string"), *tail))


def shuffle_key(seed: int | str, row_id: Column) -> Column:
    """Key whose order is a seeded shuffle of the ids: the hexadecimal digest, which sorts
    like the number it stands for."""
    return _digest(seed, row_id)


def draw32(seed: int | str, row_id: Column, salt: str = "") -> Column:
    """Whole number below 2^32."""
    return F.conv(F.substring(_digest(seed, row_id, salt), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, row_id: Column, salt: str = "") -> Column:
    """Number in [0, 1)."""
    return draw32(seed, row_id, salt) / F.lit(float(2**32))


def pick(options: Column, seed: int | str, row_id: Column, salt: str = "") -> Column:
    """One element of a non-empty array; null when the array is empty or null."""
    size = F.size(options)
    place = F.pmod(draw32(seed, row_id, salt), F.greatest(size, F.lit(1)).cast("long")).cast("int") + 1
    return F.when(size > 0, F.element_at(options, place))


def weighted_choice(shares: Mapping[str, float], seed: int | str, row_id: Column, salt: str = "") -> Column:
    """One label, drawn by its share of the total."""
    total = float(sum(shares.values()))
    u, upto, labels = uniform(seed, row_id, salt), 0.0, list(shares)
    choice = None
    for label in labels[:-1]:
        upto += shares[label]
        hit = u < F.lit(upto / total)
        choice = F.when(hit, F.lit(label)) if choice is None else choice.when(hit, F.lit(label))
    return F.lit(labels[-1]) if choice is None else choice.otherwise(F.lit(labels[-1]))
