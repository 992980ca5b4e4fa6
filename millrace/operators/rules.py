"""Row rules that say why a row was turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.code import compiles
from millrace.functions.text import strip, stripped_length
from millrace.operators.joins import attach

ACCEPTED = "accepted"
REASONS = (ACCEPTED, "failed", "too_short", "too_long", "syntax")
"""Outcomes in the order the rules are tried; the position is the outcome's code."""


def keep_successful(df: DataFrame, success: str = "success") -> DataFrame:
    return df.where(success)


def as_examples(df: DataFrame, instruction: str, output: str, *carry: str) -> DataFrame:
    """Project to (instruction, input, output, ...) with an empty input."""
    return df.select(
        F.col(instruction).alias("instruction"), F.lit("").alias("input"), F.col(output).alias("output"), *carry
    )


def length_within(text: Column, low: int = 50, high: int = 2048) -> Column:
    """Stripped length between the bounds, both included."""
    return stripped_length(text).between(low, high)


def reject_reason(
    text: Column,
    low: int = 50,
    high: int = 2048,
    success: Column | None = None,
    class_rule: tuple[Column, Column] | None = None,
) -> Column:
    """Name of the first rule that fails, `accepted` when none does.

    `class_rule` is (applies, passes): a rule that only some rows must pass. A missing text
    is too short, and a missing answer to a rule is a no.
    """
    size, no = F.coalesce(stripped_length(text), F.lit(0)), F.lit(False)
    chain = F.when(size < low, F.lit("too_short")).when(size > high, F.lit("too_long"))
    if success is not None:
        chain = F.when(~F.coalesce(success, no), F.lit("failed")).otherwise(chain)
    if class_rule:
        applies, passes = class_rule
        special = F.when(applies & ~F.coalesce(passes, no), F.lit("syntax"))
        chain = F.coalesce(chain, special)
    return F.coalesce(chain, F.lit(ACCEPTED))


def reason_code(reason: Column) -> Column:
    """Small number for a reason, so that aggregates keep fixed-width buffers."""
    return (F.array_position(F.array(*[F.lit(r) for r in REASONS]), reason) - 1).cast("int")


def with_code_check(
    df: DataFrame,
    text: str,
    is_code: Column,
    low: int = 50,
    high: int = 2048,
    success: Column | None = None,
    column: str = "reason",
) -> DataFrame:
    """The rule chain with the parser as its last rule.

    The parser sees only the rows that passed the cheap rules and hold code; every
    other row reaches the Python worker as a null.
    """
    cheap = df.withColumn(column, reject_reason(F.col(text), low, high, success))
    parsed = compiles(F.when((F.col(column) == ACCEPTED) & is_code, strip(F.col(text))))
    return cheap.withColumn(column, F.when(~parsed, F.lit("syntax")).otherwise(F.col(column)))


def score_at_least(df: DataFrame, scores: DataFrame, key: str, score: str, least: float, unscored: bool = False) -> DataFrame:
    """Keep the rows whose score, looked up by `key`, is at least `least`.

    A key with several scores counts with its largest, so no row is doubled. A row without a score, or with null ones, stays if `unscored` says so.
    """
    known = scores.groupBy(key).agg(F.max(score).alias("__score"))
    rows = attach(df, known, [key])
    return rows.where(F.coalesce(F.col("__score") >= least, F.lit(unscored))).drop("__score")
