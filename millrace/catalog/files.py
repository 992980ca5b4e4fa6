"""Write, read back, compare: the sinks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog.allocation import SPLIT_SQL
from millrace.catalog.accounts import USAGE, usage_totals
from millrace.catalog.curation import COUNTS_SQL, with_reasons
from millrace.catalog.registry import load, query, r6
from millrace.catalog.verdicts import REPORT_SQL, SCORES_SQL, STAMP, samples, score_table
from millrace.operators import dedup
from millrace.operators.cuts import exact_split
from millrace.operators.ordered import numbered
from millrace.operators.verdicts import report_lines
from millrace.plans.comparison import write_comparison
from millrace.session import fresh_folder
from millrace.sinks import tables as out
from millrace.sources import tables as src

ROW = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
ROWS_SQL = SPLIT_SQL + """select d.doc_id, d.text, '{"lang":"' || lang || '","source":"' || source || '"}' as metadata, x.split from documents d join x using (doc_id)"""


def split_rows(spark, sf):
    docs = load(spark, sf, "documents")
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return exact_split(docs.select("doc_id", "text", meta.alias("metadata")), "doc_id")


@query(ROWS_SQL)
def json_split_files(spark, sf):
    folder = fresh_folder(spark, "json-splits")
    out.write_json_splits(split_rows(spark, sf), folder)
    back = src.read_splits(spark, folder, ROW)
    return back.withColumn("metadata", F.to_json("metadata"))


@query(ROWS_SQL)
def parquet_split_files(spark, sf):
    folder = fresh_folder(spark, "parquet-splits")
    out.write_parquet_splits(split_rows(spark, sf), folder)
    back = src.read_splits(spark, folder, ROW)
    return back.withColumn("metadata", F.to_json("metadata"))


@query(ROWS_SQL)
def csv_files(spark, sf):
    folder = fresh_folder(spark, "csv")
    out.write_csv(split_rows(spark, sf), folder)
    flat = T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in ("doc_id", "text", "metadata", "split")])
    return src.read_csv(spark, folder, flat)


@query(
    SCORES_SQL
    + """select replace(replace(replace('Base (' || model || ')', ' ', '_'), '(', ''), ')', '') as model_key, 'Base (' || model || ')' as model, benchmark, round(pass_at_1, 6) as pass_at_1,
              solved_problems, total_problems from c"""
)
def results_by_model_files(spark, sf):
    folder = fresh_folder(spark, "results")
    named = score_table(spark, sf).withColumn("model", F.concat(F.lit("Base ("), F.col("model"), F.lit(")")))
    out.write_by_model(named, folder)
    schema = "model string, benchmark string, pass_at_1 double, solved_problems long, total_problems long, model_key string"
    back = spark.read.schema(schema).json(folder)
    return back.withColumn("pass_at_1", r6(F.col("pass_at_1")))


@query(f"select {USAGE} from events")
def statistics_file(spark, sf):
    folder = fresh_folder(spark, "statistics")
    totals = usage_totals(spark, sf)
    out.write_statistics(totals, folder)
    return spark.read.schema(totals.schema).json(folder)


@query(
    COUNTS_SQL
    + f""", u as (select {USAGE} from events)
        select 'documents' as name, '42' as seed, u.*, c.*, '{STAMP}' as "timestamp" from u, c"""
)
def manifest_file(spark, sf):
    folder = fresh_folder(spark, "manifest")
    docs = with_reasons(spark, sf).select("doc_id", "text", "reason")
    quality = dedup.outcome_counts(docs, "text", "doc_id", "reason")
    row = out.manifest({"name": "documents", "seed": 42}, usage_totals(spark, sf), quality, STAMP)
    row.write.json(folder)
    back = spark.read.schema(row.schema).json(folder)
    return back.select(
        F.col("settings")["name"].alias("name"), F.col("settings")["seed"].alias("seed"),
        "usage.*", "quality.*", "timestamp",
    )


REPORT_LINES_SQL = REPORT_SQL.replace("select section, \"group\", line_no, line from l", """select string_agg(line, chr(10) order by section, "group", line_no) as report from l""")
NUMBERED_SQL = f"""select unnest(range(1, len(p) + 1)) as no, unnest(p) as value from (select string_split(report, chr(10)) as p from ({REPORT_LINES_SQL}))"""


def numbered_lines(spark, folder):
    """The lines of a report's files with their place in it."""
    name = F.regexp_extract(F.input_file_name(), "[^/]+$", 0)
    lines = spark.read.text(folder, wholetext=True).select(name.alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "value"))
    return numbered(lines, [], [F.col("file"), F.col("at")], "no").select(F.col("no").cast("long"), "value")


@query(
    SCORES_SQL
    + f"""select 'summary' as part, benchmark || '_pass_at_1' as name, model, round(pass_at_1, 6) as value,
                row_number() over (partition by benchmark order by pass_at_1 desc, model) as position, null as line from c
         union all select 'results', benchmark, model, round(pass_at_1, 6), total_problems, null from c
         union all select 'report', null, null, null, no, value from ({NUMBERED_SQL})"""
)
def comparison_files(spark, sf):
    """Results per model, summary and report, written together; all three read back."""
    folder = fresh_folder(spark, "comparison")
    write_comparison(samples(spark, sf), folder, "Scores", STAMP)
    none = F.lit(None).cast("string")
    summary = spark.read.schema("metric string, model string, value double, position long").json(f"{folder}/summary")
    results = spark.read.schema("model string, benchmark string, pass_at_1 double, total_problems long, model_key string").json(f"{folder}/results")
    parts = [
        summary.select(F.lit("summary").alias("part"), F.col("metric").alias("name"), "model", r6(F.col("value")).alias("value"), "position", none.alias("line")),
        results.select(F.lit("results"), "benchmark", "model", r6(F.col("pass_at_1")), "total_problems", none),
        numbered_lines(spark, f"{folder}/report").select(F.lit("report"), none, none, F.lit(None).cast("double"), "no", "value"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(NUMBERED_SQL)
def report_file(spark, sf):
    """The report as text files; read back as lines in their order."""
    folder = fresh_folder(spark, "report")
    out.write_report(report_lines(score_table(spark, sf), "Scores", STAMP), folder)
    return numbered_lines(spark, folder)


@query("select item_id, text from benchmark")
def benchmark_rows(spark, sf):
    return load(spark, sf, "benchmark")


@query("select item_id, text from benchmark order by item_id limit 15")
def first_benchmark_rows(spark, sf):
    return src.first_rows(load(spark, sf, "benchmark"), "item_id", 15)


@query(
    """select lang, count(*) as n, any_value(name) as name from documents
       left join (select unnest(['en', 'fr', 'de']) as lang, unnest(['English', 'French', 'German']) as name) using (lang) group by lang"""
)
def record_lookup(spark, sf):
    """A table from records in memory, joined to the documents' languages; one language has no name."""
    names = src.from_records(spark, [("en", "English"), ("fr", "French"), ("de", "German")], "lang string, name string")
    counts = load(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(names, "lang", "left").select("lang", "n", "name")
