"""Masks and pseudonyms for personal data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is looked for, in this order, and what takes its place.
MASKS = {
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+": "[EMAIL]",
    r"\b[0-9a-fA-F]{32,}\b": "[SECRET]",
    r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b": "[ADDRESS]",
    r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b": "[CARD]",
}


def mask(c: Column, masks: Mapping[str, str] = MASKS) -> Column:
    """Put marks in place of every hit of the patterns, one pattern after another; null stays null."""
    for pattern, mark in masks.items():
        c = F.regexp_replace(c, pattern, mark)
    return c


def pseudonym(c: Column, salt: str, length: int = 16) -> Column:
    """The same short name for the same value, which can't be led back without the salt; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), c.cast("string")), 256), 1, length)


CHECKED = "[CARD]"
"""Hits under this mark are card numbers, and only those with a right check digit are masked or reported."""


def check_digit_ok(c: Column) -> Column:
    """Whether the digits of a text, doubled from the last but one on at every second place, add up to a multiple of ten.

    Without lambdas, which Spark runs row by row outside generated code: the places from the last
    are split into odd and even ones, a doubled digit becomes the sum of its digits by `translate`,
    and the digits are added by counting each of them.
    """
    digits = F.reverse(F.regexp_replace(c, "[^0-9]", ""))
    odd, even = F.regexp_replace(digits, "(.)(.?)", "$1"), F.regexp_replace(digits, "(.)(.?)", "$2")
    both = F.concat(odd, F.translate(even, "0123456789", "0246813579"))
    total = sum(k * (F.length(both) - F.length(F.replace(both, F.lit(str(k)), F.lit("")))) for k in range(1, 10))
    return (F.length(digits) > 0) & (total % 10 == 0)


def any_of(masks: Mapping[str, str]) -> Column:
    return F.lit("|".join(f"(?:{pattern})" for pattern in masks))


def mark_of(hit: Column, masks: Mapping[str, str]) -> Column:
    """The mark of the first pattern that fits the whole hit; null where the check digit is wrong."""
    found = F.lit(None).cast("string")
    for pattern, mark in reversed(masks.items()):
        ok = F.when(check_digit_ok(hit), mark) if mark == CHECKED else F.lit(mark)
        found = F.when(F.rlike(hit, F.lit(f"^(?:{pattern})$")), ok).otherwise(found)
    return found


def mask_checked(c: Column, masks: Mapping[str, str] = MASKS) -> Column:
    """Put marks in place of hits, the leftmost first and at one place the earlier pattern; card numbers with a
    wrong check digit stay. Null stays null."""
    between, hits = F.split(c, any_of(masks), -1), F.regexp_extract_all(c, any_of(masks), F.lit(0))
    put = F.transform(between, lambda part, i: F.concat(part, F.coalesce(mark_of(F.get(hits, i), masks), F.get(hits, i), F.lit(""))))
    return F.array_join(put, "")


def keyed_digest(c: Column, pads: Column, length: int = 64) -> Column:
    """HMAC-SHA-256 in hex of a value's text, with `pads` from `key_pads`; null stays null."""
    inner = F.unhex(F.sha2(F.concat(pads["inner"], F.encode(c.cast("string"), "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(pads["outer"], inner), 256), 1, length)


def key_pads(keys: DataFrame, key: str) -> Column:
    """The padded forms of the key that a one-row table holds, as a scalar subquery: the plan names the table, never the key."""
    raw = F.encode(F.col(key), "UTF-8")
    block = F.rpad(F.hex(F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)), 128, "0")

    def pad(byte: int) -> Column:
        one = lambda i: F.lpad(F.hex(F.conv(F.substring(block, 2 * i + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0")
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), one), ""))

    return keys.select(F.struct(pad(0x36).alias("inner"), pad(0x5C).alias("outer"))).scalar()
