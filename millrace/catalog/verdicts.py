"""Verdict tables from labels and documents, and what is made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import load, query, r6
from millrace.operators import verdicts as vd
from millrace.operators.bounds import settle
from millrace.operators.joins import attach

BENCHMARKS = ["en", "fr", "de", "es"]
STAMP = "2024-01-31 00:00:00"

SAMPLES_SQL = """
  with s as (select 'm' || (doc_id % 3) as model, lang as benchmark, (doc_id // 3) % 5 as problem, doc_id,
                    quality = 1 as good, toxic = 0 as clean, quality = 1 and toxic = 0 as passed
             from labels join documents using (doc_id))
"""
SCORES_SQL = SAMPLES_SQL + """, c as (select model, benchmark, avg(passed::int) as pass_at_1,
     count(*) filter (where passed) as solved_problems, count(*) as total_problems from s group by 1, 2)"""


def samples(spark, sf):
    """One sample per labelled document, with two tests each."""
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    rows = load(spark, sf, "labels").join(docs, "doc_id")
    return rows.select(
        F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
        F.col("lang").alias("benchmark"),
        (F.floor(F.col("doc_id") / 3) % 5).alias("problem"),
        "doc_id",
        (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 0).alias("clean"),
        vd.all_passed(F.array(F.col("quality") == 1, F.col("toxic") == 0)).alias("passed"),
    )


def score_table(spark, sf):
    return vd.scores(samples(spark, sf))


@query(SAMPLES_SQL + "select doc_id, model, benchmark, problem, passed from s")
def sample_verdicts(spark, sf):
    return samples(spark, sf).select("doc_id", "model", "benchmark", "problem", "passed")


@query(
    """with p as (select 'm' || (doc_id % 3) as model, lang as benchmark, doc_id as problem, quality = 1 and toxic = 0 as a, quality is not null as tested
                  from documents left join labels using (doc_id))
       select model, benchmark, problem, coalesce(a, true) as passed, coalesce(a, true) and tested as passed_strict,
              case when tested then 2 else 0 end::bigint as n_tests from p"""
)
def problem_verdicts(spark, sf):
    """Every document is a problem; its label gives two tests, and without a label it has none."""
    docs = load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels"), "doc_id", "left")
    tests = docs.select(
        F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
        F.col("lang").alias("benchmark"),
        F.col("doc_id").alias("problem"),
        F.explode(F.array(F.col("quality") == 1, F.col("toxic") == 0)).alias("passed"),
    )
    return vd.problem_verdicts(tests, ["model", "benchmark", "problem"])


@query(SCORES_SQL + "select model, benchmark, round(pass_at_1, 6) as pass_at_1, solved_problems, total_problems from c")
def scores(spark, sf):
    return score_table(spark, sf).withColumn("pass_at_1", r6(F.col("pass_at_1")))


@query(
    SAMPLES_SQL
    + """select model, benchmark, round(avg(passed::int), 6) as pass_at_1, count(*) filter (where passed) as solved_problems, count(*) as total_problems
         from s group by rollup (model, benchmark)"""
)
def scores_with_totals(spark, sf):
    return vd.scores_with_totals(samples(spark, sf)).withColumn("pass_at_1", r6(F.col("pass_at_1")))


@query(
    SCORES_SQL
    + """select benchmark || '_pass_at_1' as metric, model, round(pass_at_1, 6) as value,
                row_number() over (partition by benchmark order by pass_at_1 desc, model) as position from c"""
)
def leaderboard(spark, sf):
    board = vd.leaderboard(settle(vd.metric_rows(score_table(spark, sf)))[0])
    return board.withColumn("value", r6(F.col("value"))).orderBy("metric", "position")


@query(
    SCORES_SQL
    + "select model, "
    + ", ".join(f"round(max(pass_at_1) filter (where benchmark = '{b}'), 6) as {b}_pass_at_1" for b in BENCHMARKS)
    + " from c group by model"
)
def metric_columns(spark, sf):
    wide = vd.metric_columns(score_table(spark, sf))
    return wide.select("model", *[r6(F.col(c)).alias(c) for c in wide.columns if c != "model"])


@query(
    SAMPLES_SQL
    + """, g as (select model, benchmark, problem, count(*) as n, count(*) filter (where passed) as c from s group by 1, 2, 3),
           f as (select model, benchmark, n, c, k, case when n < k then null when n - c < k then 1.0::double else 1 - coalesce(list_product(
                   list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i)), 1) end as v from g, (select unnest([1, 5, 10]) as k))
       select model, benchmark, round(avg(v) filter (where k = 1), 6) as pass_at_1, round(avg(v) filter (where k = 5), 6) as pass_at_5,
              round(avg(v) filter (where k = 10), 6) as pass_at_10, count(*) filter (where k = 1) as problems from f group by 1, 2"""
)
def pass_at_k(spark, sf):
    rows = vd.mean_pass_at_k(samples(spark, sf), ["problem"], ["model", "benchmark"])
    return rows.select("model", "benchmark", *[r6(F.col(f"pass_at_{k}")).alias(f"pass_at_{k}") for k in (1, 5, 10)], "problems")


@query(
    """select 'm' || (doc_id % 3) as model, lang as benchmark, count(*) as n from documents left join labels using (doc_id)
            where quality is not null group by 1, 2"""
)
def results_without_errors(spark, sf):
    """A document without a label stands for a run that ended in an error."""
    docs = load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels"), "doc_id", "left")
    error = F.when(F.col("quality").isNull(), F.lit("no label"))
    model = F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string"))
    rows = docs.select(model.alias("model"), F.col("lang").alias("benchmark"), error.alias("error"))
    return vd.without_errors(rows).groupBy("model", "benchmark").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select c.conv_id, c.turn, p.n_turns, c.turn::double / p.n_turns as place
       from conversations c join (select conv_id, count(*) as n_turns from conversations group by 1) p using (conv_id) where c.role = 'assistant'"""
)
def problem_tests(spark, sf):
    """Problems (conversations) joined to their tests (assistant turns)."""
    turns = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    problems = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    tests = turns.where(F.col("role") == "assistant").select("conv_id", "turn")
    rows = attach(tests, problems, ["conv_id"], "inner", spread=["turn"])
    return rows.withColumn("place", F.col("turn").cast("double") / F.col("n_turns"))


REPORT_SQL = (
    SCORES_SQL
    + f""", r as (select *, row_number() over (partition by benchmark order by pass_at_1 desc, model) as pos,
                                         row_number() over (partition by model order by benchmark) as no from c),
      l as (
        select 0 as section, '' as "group", i as line_no, t as line from (select unnest(range(5)) as i, unnest(['# Scores', '', 'Generated: {STAMP}', '', '## Summary']) as t)
        union all select 1, benchmark || '_pass_at_1', pos * 2, chr(10) || '### ' || benchmark || '_pass_at_1' from r where pos = 1
        union all select 1, benchmark || '_pass_at_1', pos * 2 + 1, pos || '. ' || model || ': ' || printf('%.3f', pass_at_1) from r
        union all select 2, '', 0, chr(10) || '## Details'
        union all select 2, model, no * 5, chr(10) || '### ' || model from r where no = 1
        union all select 2, model, no * 5 + 1, chr(10) || '#### ' || upper(benchmark) from r
        union all select 2, model, no * 5 + 2, '- Pass@1: ' || printf('%.3f', pass_at_1) from r
        union all select 2, model, no * 5 + 3, '- Problems: ' || total_problems from r
        union all select 2, model, no * 5 + 4, '- Solved: ' || solved_problems from r)
      select section, "group", line_no, line from l"""
)


@query(REPORT_SQL)
def report_lines(spark, sf):
    return vd.report_lines(score_table(spark, sf), "Scores", STAMP)
