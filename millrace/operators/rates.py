"""Rate limits, checked after the fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import GROUP_ROWS, framed, group_extent, running


def rate_audit(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    row_id: str,
    tokens: Column,
    window_seconds: int = 60,
    max_requests: int = 50,
    max_tokens: int = 40_000,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """What a sliding limiter would have said to each request.

    The window of a request at time t holds the requests of its key later than
    t - window and earlier than t. Each request puts its weight on a time line just
    after t and takes it off at t + window, so a window's content is a running sum:
    the cost does not grow with the number of requests per window. The oldest request
    still inside is the successor of the last one that left.
    """
    span = window_seconds * 1_000_000
    base = df.withColumns({"__t": F.unix_micros(F.col(ts).cast("timestamp")), "__tok": tokens.cast("long")})
    order = [F.col("__t"), F.col(row_id)]
    widest, total = group_extent(df, keys)
    around = lambda w: {"__next": F.lead("__t").over(w), "__prev": F.lag("__t").over(w)}
    linked = framed(base, keys, order, around, 1, 1, limit, (widest, total))
    rest = [c for c in base.columns if c not in keys and c != row_id]
    row, none = F.struct(*rest), F.lit(None).cast("long")  # the row itself rides on its own mark alone

    def mark(phase: int, at: Column, n: int, tok: Column, oldest: Column, kept: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), at.alias("at"), F.lit(n).alias("n"), tok.alias("tok"), oldest.alias("oldest"), kept.alias("row"))

    steps = F.array(
        mark(0, F.col("__t") + 1, 1, F.col("__tok"), F.when(F.col("__prev").isNull(), F.col("__t")), F.when(F.lit(False), row)),
        mark(0, F.col("__t") + span, -1, -F.col("__tok"), F.col("__next"), F.when(F.lit(False), row)),
        mark(1, F.col("__t"), 0, F.lit(0).cast("long"), none, row),
    )
    line = linked.select(*keys, row_id, F.explode(steps).alias("__s"))
    s = "__s."
    summed = running(
        line,
        keys,
        [F.col(s + "at"), F.col(s + "phase"), F.col(row_id), F.col(s + "n")],
        sums={"in_window": F.col(s + "n"), "tokens_in_window": F.col(s + "tok")},
        maxima={"__oldest": F.col(s + "oldest")},
        limit=limit,
        extent=(3 * widest, 3 * total),
    ).where(F.col(s + "phase") == 1)
    summed = summed.select(*keys, row_id, s + "row.*", "in_window", "tokens_in_window", "__oldest")
    return verdicts(summed, span, max_requests, max_tokens).select(*df.columns, "in_window", "tokens_in_window", "rpm_hit", "tpm_hit", "wait_s", "no_history")


def verdicts(summed: DataFrame, span: int, max_requests: int, max_tokens: int) -> DataFrame:
    """Add rpm_hit, tpm_hit, wait_s and no_history to requests (__t, __tok) with their windows' content and oldest time."""
    oldest = F.when(F.col("in_window") > 0, F.col("__oldest"))
    rpm = F.col("in_window") >= max_requests
    tpm = F.col("tokens_in_window") + F.col("__tok") > max_tokens
    wait = (F.lit(span) - (F.col("__t") - oldest)) / 1e6
    return summed.withColumns(
        {
            "rpm_hit": rpm,
            "tpm_hit": tpm,
            "wait_s": F.when(rpm | tpm, wait),
            "no_history": tpm & (F.col("in_window") == 0),
        }
    )
