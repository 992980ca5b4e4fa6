"""Exact duplicates: same text apart from case and outer white space; the smallest id stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import text_key
from millrace.operators.bounds import BROADCAST_ROWS, settle
from millrace.operators.rules import REASONS, reason_code
from millrace.session import cut


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
"""Bounds of a membership filter, which is broadcast: 128 KB and 32 MB. A fuller one only lets more rows be looked up."""


def _key(text: str) -> Column:
    """Digest of a text; all missing texts are one text."""
    return F.coalesce(text_key(F.col(text)), F.lit(""))


def first_ids(df: DataFrame, text: str, row_id: str, **facts: Column) -> DataFrame:
    """(key, id, copies) per distinct text, with facts of the first row.

    Only the digest, the id and the facts are shuffled, and a crowded group is folded
    map-side.
    """
    keyed = df.select(_key(text).alias("key"), row_id, *[c.alias(n) for n, c in facts.items()])
    n = F.count(F.lit(1)).alias("copies")
    if not facts:
        return keyed.groupBy("key").agg(F.min(row_id).alias(row_id), n)
    folded = keyed.groupBy("key").agg(F.min(F.struct(row_id, *facts)).alias("first"), n)
    return folded.select("key", "first.*", "copies")


def filter_bits(keys: int) -> int:
    """Bits of a membership filter: eight a key, a power of two, within the bounds."""
    bits = LEAST_BITS
    while bits < min(8 * keys, MOST_BITS):
        bits *= 2
    return bits


def slot_of(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def membership(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(__bucket, __bits): one bit for the slot of each key, in buckets of 4 KB; the bits are set and merged map-side."""
    slots = keys.select(slot_of(F.col(key), bits).alias("__slot"))
    return slots.groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))


def bit_set(bits: Column, slot: Column) -> Column:
    """Whether the slot's bit is set in its bucket; null without a bucket."""
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at.bitwiseAND(7)) == 1


def keep_first(df: DataFrame, text: str, row_id: str, firsts: DataFrame, small: int = BROADCAST_ROWS) -> DataFrame:
    """Keep the rows that `firsts(key, id, copies, seen)`, a written table, names and that
    are not seen.

    Only texts that are seen or have copies need a look-up. While those are few, however
    many copies each has, they are sent to every task and no text is shuffled. Beyond that a
    filter of fixed size goes to the tasks: a row that it doesn't hold has an unrepeated text and
    stays where it is, and only possible repeats meet the surviving ids, unique on both sides.
    """
    first = F.when(~F.col("seen"), F.col(row_id)).alias("__first")
    special = firsts.where("seen or copies > 1").select(F.col("key").alias("__key"), first, F.lit(True).alias("__special"))
    special, few = settle(special, small)
    if few:
        rows = df.withColumn("__key", _key(text)).join(F.broadcast(special), "__key", "left")
        keep = F.col("__special").isNull() | F.coalesce(F.col("__first") == F.col(row_id), F.lit(False))
        return rows.where(keep).drop("__key", "__first", "__special")
    bits = filter_bits(special.count())
    held = F.broadcast(membership(special.select("__key"), "__key", bits))
    slot = slot_of(_key(text), bits)
    rows = df.withColumn("__slot", slot).withColumn("__bucket", F.bitmap_bucket_number("__slot")).join(held, "__bucket", "left")
    possible = F.coalesce(bit_set(F.col("__bits"), F.col("__slot")), F.lit(False))
    alone = rows.where(~possible).select(df.columns)
    again = rows.where(possible).select(df.columns)
    left = firsts.where("not seen").withColumn("__slot", slot_of(F.col("key"), bits)).withColumn("__bucket", F.bitmap_bucket_number("__slot"))
    left = left.join(held, "__bucket").where(possible).select(row_id)
    return alone.union(again.join(left, row_id, "left_semi").select(df.columns))


def drop_copies(df: DataFrame, text: str, row_id: str, small: int = BROADCAST_ROWS) -> DataFrame:
    """Keep the first row of each text."""
    return keep_first(df, text, row_id, cut(first_ids(df, text, row_id).withColumn("seen", F.lit(False))), small)


def drop_seen(df: DataFrame, text: str, row_id: str, seen: DataFrame, small: int = BROADCAST_ROWS) -> DataFrame:
    """Keep the first row of each text whose key is not in `seen(key)`.

    Both sides of the key join are unique on the key, so no key is crowded there.
    """
    known = seen.select("key").distinct().withColumn("__known", F.lit(True))
    firsts = first_ids(df, text, row_id).join(known, "key", "left")
    firsts = cut(firsts.withColumn("seen", F.col("__known").isNotNull()).drop("__known"))
    return keep_first(df, text, row_id, firsts, small)


def outcome_counts(df: DataFrame, text: str, row_id: str, reason: str) -> DataFrame:
    """One row of counters. Copies count once, as duplicates, and meet no other rule."""
    firsts = df.groupBy(_key(text).alias("key")).agg(
        F.min_by(reason_code(F.col(reason)), F.col(row_id)).alias("code"), F.count(F.lit(1)).alias("copies")
    )
    return count_outcomes(firsts)


def count_outcomes(firsts: DataFrame) -> DataFrame:
    """The counters from one row per text with its outcome `code` and number of `copies`."""

    def having(*names: str):
        return F.count_if(F.col("code").isin([REASONS.index(n) for n in names]))

    return firsts.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count(F.lit(1)).alias("total_generated"),
        having("failed").alias("failed"),
        having("too_short", "too_long").alias("quality_filtered"),
        having("syntax").alias("syntax_errors"),
        having("accepted").alias("accepted"),
    )


def outcome_rates(counts: DataFrame) -> DataFrame:
    """Add the rates; all are null when nothing was processed."""
    total = F.nullif(F.col("total_generated"), F.lit(0))
    return counts.withColumns(
        {
            "acceptance_rate": F.col("accepted") / total,
            "duplicate_rate": F.col("duplicates_removed") / total,
            "quality_filter_rate": F.col("quality_filtered") / total,
            "syntax_error_rate": F.col("syntax_errors") / total,
            "duplicate_share": F.col("duplicates_removed") / F.nullif(F.col("candidates"), F.lit(0)),
        }
    )


def repeat_rate(df: DataFrame, text: str, target: float = 0.8) -> DataFrame:
    """Share of rows whose normalised text was there before, and whether it meets `target`."""
    keys = df.groupBy(_key(text).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rate = F.col("repeats") / F.greatest(F.col("requests"), F.lit(1))
    return (
        keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))
        .withColumn("hit_rate", rate)
        .withColumn("meets_target", F.col("hit_rate") >= target)
    )
