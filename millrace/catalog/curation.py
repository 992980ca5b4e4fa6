"""Rules, duplicates, counters and the whole curation plan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog.registry import key_sql, load, norm_sql, query, r6, strip_sql
from millrace.catalog.texts import part_code
from millrace.functions.text import contains_any
from millrace.operators import dedup, rules
from millrace.operators.ledger import completion, usage_totals
from millrace.operators.ordered import top_per_key
from millrace.plans.curation import curated_summary, write_curated
from millrace.session import fresh_folder
from millrace.sources.tables import read_splits

REASON_SQL = f"""case when length({strip_sql('text')}) < 50 then 'too_short'
                      when length({strip_sql('text')}) > 2048 then 'too_long'
                      when lang = 'en' and not contains(text, ' the ') then 'syntax' else 'accepted' end"""


def with_reasons(spark, sf):
    """Documents with the outcome of the rule chain; one rule holds for one language only."""
    english = (F.col("lang") == "en", F.contains(F.col("text"), F.lit(" the ")))
    reason = rules.reject_reason(F.col("text"), class_rule=english)
    return load(spark, sf, "documents").withColumn("reason", reason)


@query("select event_id, user_id, value from events where event_type <> 'error'")
def successful_events(spark, sf):
    events = load(spark, sf, "events").withColumn("success", F.col("event_type") != "error")
    return rules.keep_successful(events).select("event_id", "user_id", "value")


@query("select lang || ':' || source as instruction, '' as input, text as output, doc_id from documents")
def example_rows(spark, sf):
    docs = load(spark, sf, "documents").withColumn("ask", F.concat_ws(":", "lang", "source"))
    return rules.as_examples(docs, "ask", "text", "doc_id")


@query(f"select doc_id from documents where length({strip_sql('text')}) between 50 and 2048")
def length_filtered(spark, sf):
    return load(spark, sf, "documents").where(rules.length_within(F.col("text"))).select("doc_id")


@query(
    f"""select conv_id, turn from conversations where role = 'user' and length({strip_sql('text')}) between 10 and 500"""
)
def question_length_filtered(spark, sf):
    turns = load(spark, sf, "conversations").where(F.col("role") == "user")
    return turns.where(rules.length_within(F.col("text"), 10, 500)).select("conv_id", "turn")


@query(f"select doc_id, {REASON_SQL} as reason from documents")
def reject_reasons(spark, sf):
    return with_reasons(spark, sf).select("doc_id", "reason")


@query(
    """select doc_id from documents left join labels using (doc_id) where coalesce(quality >= 1, true)"""
)
def good_or_unscored(spark, sf):
    """Documents labelled as good, and those without a label."""
    docs = load(spark, sf, "documents").select("doc_id")
    return rules.score_at_least(docs, load(spark, sf, "labels"), "doc_id", "quality", 1, unscored=True)


@query(
    """with scores as (select o_custkey as c_custkey, o_totalprice as price from orders)
       select c_custkey from customer left join (select c_custkey, max(price) as price from scores group by 1) using (c_custkey) where price >= 300000"""
)
def large_customers(spark, sf):
    """Customers with an order of 300,000 or more; a customer has many orders, hence many scores."""
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return rules.score_at_least(load(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "o_totalprice", 300_000)


@query(f"select lang, {REASON_SQL} as reason, count(*) as n from documents group by all")
def reason_counts(spark, sf):
    return with_reasons(spark, sf).groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select p_partkey, case when p_partkey % 7 = 0 then case when p_size % 2 = 0 then 'syntax' else 'accepted' end
                              when p_partkey % 5 = 0 then 'too_short' else 'accepted' end as reason from part"""
)
def code_checked(spark, sf):
    """The rule chain with the parser last, over programs made from the parts."""
    rows = rules.with_code_check(part_code(spark, sf), "code", F.col("p_size") % 2 == 0, low=10, high=2048)
    return rows.select("p_partkey", "reason")


FIRSTS_SQL = f"""select md5({norm_sql('text')}) as key, min(doc_id) as doc_id, count(*) as copies from documents group by 1"""


@query(f"select d.doc_id, d.lang from documents d join ({FIRSTS_SQL}) f using (doc_id)")
def copies_dropped(spark, sf):
    return dedup.drop_copies(load(spark, sf, "documents"), "text", "doc_id").select("doc_id", "lang")


@query(f"select d.doc_id, d.lang from documents d join ({FIRSTS_SQL}) f using (doc_id)")
def copies_dropped_by_filter(spark, sf):
    """The same by the way that tables with very many repeated texts take."""
    return dedup.drop_copies(load(spark, sf, "documents"), "text", "doc_id", small=0).select("doc_id", "lang")


@query(FIRSTS_SQL)
def first_ids(spark, sf):
    return dedup.first_ids(load(spark, sf, "documents"), "text", "doc_id").select("key", "doc_id", "copies")


@query(
    f"""with seen as (select distinct md5({norm_sql('text')}) as key from documents where source = 'src3'),
             f as ({FIRSTS_SQL})
        select doc_id from f where key not in (select key from seen)"""
)
def unseen_texts(spark, sf):
    docs = load(spark, sf, "documents")
    seen = dedup.first_ids(docs.where(F.col("source") == "src3"), "text", "doc_id").select("key")
    return dedup.drop_seen(docs, "text", "doc_id", seen).select("doc_id")


COUNTS_SQL = f"""
  with r as (select doc_id, md5({norm_sql('text')}) as key, {REASON_SQL} as reason from documents),
       f as (select key, arg_min(reason, doc_id) as reason, count(*) as copies from r group by key),
       c as (select sum(copies)::bigint as candidates, sum(copies - 1)::bigint as duplicates_removed,
                    count(*) as total_generated, 0::bigint as failed,
                    count(*) filter (where reason in ('too_short', 'too_long')) as quality_filtered,
                    count(*) filter (where reason = 'syntax') as syntax_errors,
                    count(*) filter (where reason = 'accepted') as accepted from f)
"""


@query(
    COUNTS_SQL
    + """select *, round(accepted / total_generated, 6) as acceptance_rate, round(duplicates_removed / total_generated, 6) as duplicate_rate,
                round(quality_filtered / total_generated, 6) as quality_filter_rate, round(syntax_errors / total_generated, 6) as syntax_error_rate,
                round(duplicates_removed / candidates, 6) as duplicate_share from c"""
)
def outcome_rates(spark, sf):
    docs = with_reasons(spark, sf).select("doc_id", "text", "reason")
    rates = dedup.outcome_rates(dedup.outcome_counts(docs, "text", "doc_id", "reason"))
    return rates.select(*[r6(F.col(c)).alias(c) if c.endswith(("rate", "share")) else c for c in rates.columns])


@query(
    COUNTS_SQL
    + """, u as (select count(*) as n, round(sum(value) filter (where event_type <> 'error'), 6) as cost from events)
       select 25000::bigint as target_size, accepted as actual_size, round(accepted / 25000, 6) as completion_rate,
              n as total_api_calls, cost as total_cost, round(cost / greatest(accepted, 1), 6) as average_cost_per_example from c, u"""
)
def completion_report(spark, sf):
    docs = with_reasons(spark, sf).select("doc_id", "text", "reason")
    counts = dedup.outcome_counts(docs, "text", "doc_id", "reason")
    events = load(spark, sf, "events")
    usage = usage_totals(events, F.col("event_type") != "error", F.floor("value"), F.col("value"))
    report = completion(counts, usage, 25_000)
    money = ("completion_rate", "total_cost", "average_cost_per_example")
    return report.select(*[r6(F.col(c)).alias(c) if c in money else c for c in report.columns])


@query(
    f"""with k as (select {norm_sql("event_type || ':' || user_id")} as key, count(*) as n from events group by 1),
             s as (select sum(n)::bigint as requests, sum(n - 1)::bigint as repeats from k)
        select requests, repeats, round(repeats / greatest(requests, 1), 6) as hit_rate, repeats / greatest(requests, 1) >= 0.8 as meets_target from s"""
)
def repeat_rate(spark, sf):
    events = load(spark, sf, "events").select(F.concat_ws(":", "event_type", "user_id").alias("ask"))
    return dedup.repeat_rate(events, "ask").withColumn("hit_rate", r6(F.col("hit_rate")))


@query(
    """select p_brand, p_partkey, p_name from (
         select *, row_number() over (partition by p_brand order by p_partkey) as rn from part
         where contains(lower(p_name), 'ring') or contains(lower(p_name), 'bolt')) where rn <= 4"""
)
def matching_names(spark, sf):
    """At most four matching names per brand. Spark cuts each task's share to four before the shuffle."""
    hits = load(spark, sf, "part").where(contains_any(F.col("p_name"), ["ring", "Bolt"]))
    return top_per_key(hits, ["p_brand"], [F.col("p_partkey")], 4).select("p_brand", "p_partkey", "p_name")


CURATED_SQL = f"""
  with k as (select md5({norm_sql('text')}) as key, min(doc_id) as doc_id from documents group by 1),
       a as (select d.doc_id, d.lang, length({strip_sql('text')}) as n, {key_sql('d.doc_id')} as sk
             from documents d join k using (doc_id) where length({strip_sql('text')}) between 50 and 2048),
       t as (select floor(count(*) * 0.8)::bigint as n1, floor(count(*) * 0.1)::bigint as n2 from a),
       s as (select a.*, row_number() over (order by sk, doc_id) as rn from a)
  select case when rn <= n1 then 'train' when rn <= n1 + n2 then 'validation' else 'test' end as split, lang,
         count(*) as n_docs, round(avg(n), 6) as mean_length from s, t group by 1, 2
"""


@query(CURATED_SQL)
def curated(spark, sf):
    return curated_summary(load(spark, sf, "documents")).withColumn("mean_length", r6(F.col("mean_length")))


@query(
    CURATED_SQL[: CURATED_SQL.index("  select case when rn")]
    + """select a2.doc_id, d.text, case when rn <= n1 then 'train' when rn <= n1 + n2 then 'validation' else 'test' end as split
         from s a2 join documents d using (doc_id), t"""
)
def curated_files(spark, sf):
    """The build written as JSON lines per split, and read back."""
    folder = fresh_folder(spark, "curated")
    events = load(spark, sf, "events")
    usage = usage_totals(events, F.col("event_type") != "error", F.floor("value"), F.col("value"))
    write_curated(load(spark, sf, "documents"), usage, folder, "2024-01-31 00:00:00")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return read_splits(spark, f"{folder}/rows", schema)
