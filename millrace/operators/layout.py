"""Conversation turns laid out as pairs and fixed-width rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import IGNORED, fit_length, mask_first, presence_mask
from millrace.functions.text import words
from millrace.operators.ordered import GROUP_ROWS, framed


def turn_pairs(turns: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Each user turn with the assistant turn right after it."""

    def make(w):
        return {"__role": F.lead("role").over(w), "output": F.lead("text").over(w)}

    rows = framed(turns, ["conv_id"], [F.col("turn")], make, ahead=1, limit=limit, wide=["text"])
    pairs = rows.where((F.col("role") == "user") & (F.col("__role") == "assistant"))
    return pairs.select("conv_id", "turn", F.col("text").alias("instruction"), "output")


# The headings of a pair.
FIRST_HEADING = "### Instruction:\n"
SECOND_HEADING = "\n\n### Response:\n"


def pair_head(instruction: Column) -> Column:
    return F.concat(F.lit(FIRST_HEADING), instruction, F.lit(SECOND_HEADING))


def pair_text(instruction: Column, output: Column, end: str = "") -> Column:
    return F.concat(pair_head(instruction), output, F.lit(end))


def fixed_rows(pairs: DataFrame, width: int, pad: str = "<pad>") -> DataFrame:
    """White-space tokens cut or filled to `width`, a presence mask, and word lengths with
    the head of the pair masked out."""
    head, whole = pair_head(F.col("instruction")), pair_text(F.col("instruction"), F.col("output"))
    rows = pairs.withColumns({"__tokens": words(whole), "__head": F.size(words(head))})
    fitted = rows.withColumns({"tokens": fit_length(F.col("__tokens"), width, pad), "mask": presence_mask(F.col("__tokens"), width)})
    sizes = F.transform("tokens", lambda t: F.length(t))
    return fitted.withColumn("labels", mask_first(sizes, F.col("__head"), IGNORED)).drop("__tokens", "__head")
