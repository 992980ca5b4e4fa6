"""Lookups in settings tables, with fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.draws import pick
from millrace.functions.text import fill_slots, task_slots
from millrace.operators.joins import attach, meet
from millrace.sources.tables import from_records


def template_table(spark: SparkSession, templates: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """(language, difficulty, templates) from a nested mapping."""
    rows = [(a, b, list(texts)) for a, levels in templates.items() for b, texts in levels.items()]
    return from_records(spark, rows, "language string, difficulty string, templates array<string>")


def task_table(spark: SparkSession, tasks: Mapping[str, Sequence[str]]) -> DataFrame:
    """(category, tasks) from a mapping."""
    rows = [(c, list(texts)) for c, texts in tasks.items()]
    return from_records(spark, rows, "category string, tasks array<string>")


def share_table(spark: SparkSession, shares: Mapping[str, float]) -> DataFrame:
    return from_records(spark, [(k, float(v)) for k, v in shares.items()], "label string, pct double")


def with_template(df: DataFrame, templates: DataFrame, fallback: Sequence[str], row_id: str, seed: int | str) -> DataFrame:
    """Pick one template per row by (language, difficulty); unknown pairs use the fallback.

    `{language}` in a fallback becomes the row's language.
    """
    found = attach(df, templates, ["language", "difficulty"], "left", spread=[row_id])
    spare = F.array(*[F.replace(F.lit(t), F.lit("{language}"), F.col("language")) for t in fallback])
    options = F.when(F.size("templates") > 0, F.col("templates")).otherwise(spare)
    return found.withColumn("template", pick(options, seed, F.col(row_id), "template")).drop("templates")


def with_task(
    df: DataFrame,
    categories: Mapping[str, Sequence[str]],
    other: Sequence[str],
    tasks: DataFrame,
    fallback: str,
    row_id: str,
    seed: int | str,
) -> DataFrame:
    """Draw a category by difficulty, then one of its tasks; a category without tasks
    gives the fallback text."""
    options = F.array(*[F.lit(c) for c in other])
    for level, names in categories.items():
        options = F.when(F.col("difficulty") == level, F.array(*[F.lit(c) for c in names])).otherwise(options)
    drawn = df.withColumn("category", pick(options, seed, F.col(row_id), "category"))
    found = attach(drawn, tasks, ["category"], "left", spread=[row_id])
    task = F.coalesce(pick(F.col("tasks"), seed, F.col(row_id), "task"), F.lit(fallback))
    return found.withColumn("task", task).drop("tasks")


def filled(template: Column, task: Column) -> Column:
    return fill_slots(template, task_slots(task))


def overlay(base: DataFrame, over: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Both settings tables as one; where a key (null as well) is in both, `over` wins."""
    left = base.select(key, F.col(value).alias("__a"))
    right = over.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in"))
    joined = meet(left, right, [key], "full_outer")
    return joined.select(key, F.when(F.col("__in"), F.col("__b")).otherwise(F.col("__a")).alias(value))


def overlay_maps(base: Column, over: Column) -> Column:
    """Map columns as one; where a key is in both, `over` wins. A null map counts as empty; two null maps give null."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.when(base.isNull(), over).when(over.isNull(), base).otherwise(F.map_concat(kept, over))
