"""Where personal data stands in a text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.privacy import MASKS, any_of, mark_of
from millrace.operators.ordered import GROUP_ROWS, running
from millrace.session import cut


def personal_spans(df: DataFrame, row_id: str, text: str, masks: Mapping[str, str] = MASKS, limit: int = GROUP_ROWS) -> DataFrame:
    """(row_id, mark, start, length) of every hit that `mask_checked` would replace, in code points of the original text, from 0.

    `row_id` is unique. Lengths alone are shuffled and added up, no text; a text with very many hits is
    spread over tasks as `running` does. A null text has no hits.
    """
    pieces = F.split(text, any_of(masks), -1)
    hits = F.regexp_extract_all(text, any_of(masks), F.lit(0))
    steps = F.transform(
        hits, lambda hit, i: F.struct(i.alias("at"), F.length(F.get(pieces, i)).alias("gap"), F.length(hit).alias("length"), mark_of(hit, masks).alias("mark"))
    )
    line = cut(df.select(row_id, F.explode(steps).alias("s")).select(row_id, "s.*"))  # the patterns are matched once
    ended = running(line, [row_id], [F.col("at")], sums={"end": F.col("gap") + F.col("length")}, limit=limit)
    return ended.where(F.col("mark").isNotNull()).select(row_id, "mark", (F.col("end") - F.col("length")).alias("start"), F.col("length").cast("long").alias("length"))
