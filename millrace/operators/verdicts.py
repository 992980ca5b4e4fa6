"""Pass/fail aggregation, leaderboards and the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ratio, score_text
from millrace.operators.bounds import settle
from millrace.operators.ordered import GROUP_ROWS, numbered


def problem_verdicts(tests: DataFrame, keys: Sequence[str], passed: str = "passed") -> DataFrame:
    """Whether every test of a problem passed, and whether it had any. A null `passed` stands
    for a problem without tests: it passes, but not under the strict flag."""
    folded = tests.groupBy(*keys).agg(F.bool_and(passed).alias("__all"), F.count(passed).alias("n_tests"))
    every = F.coalesce("__all", F.lit(True))
    return folded.select(*keys, every.alias("passed"), (every & (F.col("n_tests") > 0)).alias("passed_strict"), "n_tests")


def all_passed(tests: Column) -> Column:
    """The same for tests kept in an array; true for an empty one."""
    return F.forall(tests, lambda t: t)


def scores(verdicts: DataFrame, keys: Sequence[str] = ("model", "benchmark"), passed: str = "passed") -> DataFrame:
    """pass@1, solved and total per group."""
    n = F.count(F.lit(1))
    return verdicts.groupBy(*keys).agg(
        ratio(F.count_if(passed), n).alias("pass_at_1"), F.count_if(passed).alias("solved_problems"), n.alias("total_problems")
    )


def scores_with_totals(verdicts: DataFrame, keys: Sequence[str] = ("model", "benchmark"), passed: str = "passed") -> DataFrame:
    """`scores` with subtotals; a null key stands for all its values."""
    n = F.count(F.lit(1))
    return verdicts.rollup(*keys).agg(
        ratio(F.count_if(passed), n).alias("pass_at_1"), F.count_if(passed).alias("solved_problems"), n.alias("total_problems")
    )


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of `k` samples passes, given `c` of `n` passed: 1 - C(n-c,k)/C(n,k).

    The product has k factors whatever n is. Null when there are fewer than k samples.
    """
    miss = F.lit(1.0)
    for j in range(k):
        miss = miss * ((n - c - j) / (n - j))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(1 - miss)


def mean_pass_at_k(samples: DataFrame, problem: Sequence[str], group: Sequence[str], ks: Sequence[int] = (1, 5, 10), passed: str = "passed") -> DataFrame:
    """pass@k averaged over the problems of a group that have enough samples."""
    counts = samples.groupBy(*group, *problem).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("c"))
    each = [F.avg(pass_at_k(F.col("n"), F.col("c"), k)).alias(f"pass_at_{k}") for k in ks]
    return counts.groupBy(*group).agg(*each, F.count(F.lit(1)).alias("problems"))


def without_errors(results: DataFrame, error: str = "error") -> DataFrame:
    return results.where(F.col(error).isNull())


def leaderboard(table: DataFrame, metric: str = "metric", value: str = "value", name: str = "model", limit: int = GROUP_ROWS) -> DataFrame:
    """Position per metric, best first; equal values go by name."""
    return numbered(table, [metric], [F.col(value).desc(), F.col(name)], "position", limit)


def metric_rows(table: DataFrame, prefix: str = "benchmark") -> DataFrame:
    """Scores in long form: (metric, model, value)."""
    return table.select(
        F.concat(F.col(prefix), F.lit("_pass_at_1")).alias("metric"), "model", F.col("pass_at_1").alias("value")
    )


def metric_columns(table: DataFrame) -> DataFrame:
    """Scores in wide form, one column for every benchmark that the table holds, in order of
    their names. The scores are computed once; their benchmarks are few, as they become columns."""
    table, _ = settle(table)
    wide = table.groupBy("model").pivot("benchmark").agg(F.first("pass_at_1"))
    return wide.select("model", *[F.col(f"`{b}`").alias(f"{b}_pass_at_1") for b in wide.columns if b != "model"])


def report_lines(table: DataFrame, title: str, generated_at: str, limit: int = GROUP_ROWS) -> DataFrame:
    """The report as rows (section, group, line_no, line), to be written in that order.

    Section 0 is the head, 1 the ranking per metric, 2 the details per model. The scores
    are used several times, so they are computed once first.
    """
    table, few = settle(table)
    extent = (1, 1) if few else None  # so few rows need no look at their groups

    def lines(section: int, group: Column, start: Column, texts: list[Column]) -> Column:
        rows = [
            F.struct(F.lit(section).alias("section"), group.alias("group"), (start + i).cast("long").alias("line_no"), t.alias("line"))
            for i, t in enumerate(texts)
        ]
        return F.filter(F.array(*rows), lambda r: r["line"].isNotNull())

    spark = table.sparkSession
    head = [f"# {title}", "", f"Generated: {generated_at}", "", "## Summary"]
    top = spark.range(1).select(F.explode(lines(0, F.lit(""), F.lit(0), [F.lit(t) for t in head])).alias("l"))

    board = numbered(metric_rows(table), ["metric"], [F.col("value").desc(), F.col("model")], "position", limit, extent)
    opening = F.when(F.col("position") == 1, F.concat(F.lit("\n### "), F.col("metric")))
    entry = F.concat(F.col("position").cast("string"), F.lit(". "), F.col("model"), F.lit(": "), score_text(F.col("value")))
    ranks = board.select(F.explode(lines(1, F.col("metric"), F.col("position") * 2, [opening, entry])).alias("l"))

    listed = numbered(table, ["model"], [F.col("benchmark")], "__no", limit, extent)
    opening = F.when(F.col("__no") == 1, F.concat(F.lit("\n### "), F.col("model")))
    detail = [
        opening,
        F.concat(F.lit("\n#### "), F.upper("benchmark")),
        F.concat(F.lit("- Pass@1: "), score_text(F.col("pass_at_1"))),
        F.concat(F.lit("- Problems: "), F.col("total_problems").cast("string")),
        F.concat(F.lit("- Solved: "), F.col("solved_problems").cast("string")),
    ]
    details = listed.select(F.explode(lines(2, F.col("model"), F.col("__no") * 5, detail)).alias("l"))
    second = spark.range(1).select(F.explode(lines(2, F.lit(""), F.lit(0), [F.lit("\n## Details")])).alias("l"))
    return top.unionByName(ranks).unionByName(second).unionByName(details).select("l.*")
