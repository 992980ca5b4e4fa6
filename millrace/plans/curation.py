"""Text in, labelled, written and summarised rows out: rules, first copies, split, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import stripped_length
from millrace.operators import dedup, rules
from millrace.operators.cuts import exact_split, split_column
from millrace.session import cut
from millrace.sinks import tables as out


def accepted_rows(docs: DataFrame, low: int = 50, high: int = 2048) -> DataFrame:
    """(doc_id, lang, n) of the first copy of each text, when it passes the length rule.

    The texts are read once and never shuffled: only digest, id, language and length
    go on. Language and length are folded with the id, so no join brings them back.
    """
    firsts = dedup.first_ids(docs, "text", "doc_id", lang=F.col("lang"), n=stripped_length(F.col("text")))
    return firsts.where(F.col("n").between(low, high)).select("doc_id", "lang", "n")


def curated_summary(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Rows and mean length per split and language."""
    accepted = cut(accepted_rows(docs))
    split = exact_split(accepted, "doc_id", seed=seed)
    return split.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_length"))


def write_curated(
    docs: DataFrame, usage: DataFrame, folder: str, written_at: str, form: str = "json", low: int = 50, high: int = 2048, seed: int = 42
) -> None:
    """The whole build: `rows/split=*` in JSON lines or Parquet, and `manifest`.

    The texts are read twice, once to find the first copies and once to write them, and
    are not shuffled while the repeated texts are few.
    """
    reason = rules.reject_reason(F.col("text"), low, high)
    firsts = dedup.first_ids(docs, "text", "doc_id", code=rules.reason_code(reason)).withColumn("seen", F.lit(False))
    firsts = cut(firsts)
    label = split_column(firsts.where("code = 0").select("doc_id"), "doc_id", seed=seed)
    rows = dedup.keep_first(docs, "text", "doc_id", firsts).where(reason == rules.ACCEPTED).withColumn("split", label)
    write = {"json": out.write_json_splits, "parquet": out.write_parquet_splits}[form]
    write(rows, f"{folder}/rows")
    settings = {"low": low, "high": high, "seed": seed, "form": form}
    quality = dedup.outcome_rates(dedup.count_outcomes(firsts))
    out.manifest(settings, usage, quality, written_at).write.json(f"{folder}/manifest")
