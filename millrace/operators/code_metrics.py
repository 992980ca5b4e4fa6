"""Size, branching and comment density of code held in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.code import branching, syntax_facts
from millrace.functions.text import comment_density, line_count


def code_quality(df: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """Add length, lines, complexity, readability, docstrings and parse_ok.

    Text that does not parse has null complexity and readability, or 1.0 in compat mode.
    """
    code, rows = F.col(text), df.withColumn("__facts", syntax_facts(F.col(text)))
    parsed = F.col("__facts.nodes").isNotNull()
    other = F.lit(1.0 if compat else None).cast("double")
    return rows.withColumns(
        {
            "length": F.length(code),
            "lines": line_count(code),
            "complexity": F.when(parsed, branching(F.col("__facts.nodes")).cast("double")).otherwise(other),
            "readability": F.when(parsed, comment_density(code)).otherwise(other),
            "docstrings": F.col("__facts.docstrings"),
            "parse_ok": parsed,
        }
    ).drop("__facts")
