"""Usage ledgers over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import load, query, r6
from millrace.operators import ledger
from millrace.operators.lookups import overlay, overlay_maps, share_table
from millrace.operators.rolling import divergence, weighted_mean

USAGE = """count(*) as total_requests, count(*) filter (where event_type = 'error') as failed_requests,
           coalesce(sum(floor(value)) filter (where event_type <> 'error'), 0)::bigint as total_tokens,
           round(coalesce(sum(value) filter (where event_type <> 'error'), 0), 6) as total_cost,
           round(count(*) filter (where event_type <> 'error') / greatest(count(*), 1), 6) as success_rate,
           round(coalesce(sum(floor(value)) filter (where event_type <> 'error'), 0) / greatest(count(*), 1), 6) as average_tokens_per_request,
           round(coalesce(sum(value) filter (where event_type <> 'error'), 0) / greatest(count(*), 1), 6) as average_cost_per_request"""


def _usage(events, by=()):
    rows = ledger.usage_totals(events, F.col("event_type") != "error", F.floor("value"), F.col("value"), by)
    rounded = ("total_cost", "success_rate", "average_tokens_per_request", "average_cost_per_request")
    return rows.select(*[r6(F.col(c)).alias(c) if c in rounded else c for c in rows.columns])


@query(f"select {USAGE} from events")
def usage_totals(spark, sf):
    return _usage(load(spark, sf, "events"))


@query(f"select user_id, {USAGE} from events group by user_id")
def usage_by_user(spark, sf):
    return _usage(load(spark, sf, "events"), ("user_id",))


@query(
    """select lang, count(*) as total_examples, round(avg(length(text) // 4), 6) as average_tokens, sum(length(text) // 4)::bigint as total_tokens,
              round(avg(n_chars / 100), 6) as average_time, round(sum(n_chars / 100), 6) as total_time, grouping(lang) = 1 as is_total
       from documents group by rollup (lang)"""
)
def dataset_totals(spark, sf):
    rows = ledger.dataset_totals(load(spark, sf, "documents"), "lang", F.floor(F.length("text") / 4), F.col("n_chars") / 100)
    rounded = ("average_tokens", "average_time", "total_time")
    cols = [r6(F.col(c)).alias(c) if c in rounded else F.col(c) for c in rows.columns if c != "is_total"]
    return rows.select(*cols, (F.col("is_total") == 1).alias("is_total"))


def _batch_sql(size: int) -> str:
    return f"""with b as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // {size} as batch from events)
               select user_id, batch::bigint as batch, count(*) as n, count(*) filter (where event_type <> 'error') as succeeded from b group by 1, 2"""


def _batches(spark, sf, size):
    rows = ledger.batches(load(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], size)
    return rows.groupBy("user_id", F.col("batch").cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("succeeded")
    )


@query(_batch_sql(100))
def batch_success(spark, sf):
    return _batches(spark, sf, 100)


@query(_batch_sql(10))
def small_batch_success(spark, sf):
    return _batches(spark, sf, 10)


@query("select event_id // 100 as batch, count(*) as n, count(*) filter (where event_type <> 'error') as succeeded from events group by 1")
def id_batch_success(spark, sf):
    rows = ledger.id_batches(load(spark, sf, "events"), "event_id", 100)
    return rows.groupBy(F.col("batch").cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "error").alias("succeeded")
    )


@query(
    """with r as (select *, sum(value::decimal(18, 6)) over (partition by user_id order by ts, event_id) as spent from events)
       select user_id, round(sum(value::decimal(18, 6))::double, 6) as total_cost,
              coalesce(arg_min(event_id, (ts, event_id)) filter (where spent >= 400), -1) as alert_row,
              coalesce(arg_min(event_id, (ts, event_id)) filter (where spent >= 500), -1) as limit_row from r group by user_id"""
)
def spend_alerts(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    rows = ledger.spend_alerts(events, "user_id", "ts", "event_id", F.col("value").cast("decimal(18,6)"))
    none = F.lit(-1).cast("long")
    return rows.select(
        "user_id",
        r6(F.col("total_cost").cast("double")).alias("total_cost"),
        F.coalesce("alert_row", none).alias("alert_row"),
        F.coalesce("limit_row", none).alias("limit_row"),
    )


@query(
    """select user_id, epoch_us(date_trunc('day', ts)) as day_us, sum(floor(value))::bigint as tokens,
              round(sum(cast(json_extract(props, '$.k') as bigint) / 10), 6) as seconds,
              round(sum(floor(value)) / nullif(sum(cast(json_extract(props, '$.k') as bigint) / 10), 0), 6) as tokens_per_second
       from events group by 1, 2"""
)
def throughput(spark, sf):
    events = load(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    day = F.unix_micros(F.window("ts", "1 day")["start"]).alias("day_us")
    rows = ledger.throughput(events, ["user_id", day], F.floor("value"), F.col("k") / 10)
    return rows.select("user_id", "day_us", "tokens", r6(F.col("seconds")).alias("seconds"), r6(F.col("tokens_per_second")).alias("tokens_per_second"))


@query(
    """with f as (select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) as partkey from lineitem group by 1)
       select o_orderkey, coalesce(partkey, -1) as partkey, partkey is not null as success, case when partkey is null then 'no response' end as error
       from orders left join f on o_orderkey = l_orderkey"""
)
def paired_orders(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey")
    lines = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place")
    )
    rows = ledger.paired(orders, lines, "o_orderkey", "place", ["l_partkey"])
    return rows.select("o_orderkey", F.coalesce("response.l_partkey", F.lit(-1)).alias("partkey"), "success", "error")


@query(
    """select user_id, round(sum(case when event_type in ('purchase', 'signup') then 2.0 else 1.0 end * value) / count(*), 6) as weighted_mean,
              count(*) as rows_used from events where event_type <> 'error' group by 1"""
)
def weighted_means(spark, sf):
    events = load(spark, sf, "events")
    kind = F.col("event_type")
    rows = weighted_mean(events, ["user_id"], F.col("value"), kind.isin("purchase", "signup"), kind == "error")
    return rows.withColumn("weighted_mean", r6(F.col("weighted_mean")))


@query(
    """select user_id, round(sum(value) / count(*), 6) as weighted_mean, count(*) as rows_used from events
       where event_type is null or event_type = 'click' or event_type <> 'error' group by 1"""
)
def means_with_null_mask(spark, sf):
    """As above with a mask that is null for clicks, which are used, and no weights."""
    events = load(spark, sf, "events")
    mask = F.when(F.col("event_type") != "click", F.col("event_type") == "error")
    rows = weighted_mean(events, ["user_id"], F.col("value"), F.lit(False), mask)
    return rows.withColumn("weighted_mean", r6(F.col("weighted_mean")))


@query(
    """select event_id, case when event_id % 3 = 0 then 'own' else event_type end as kind, case when event_id % 2 = 0 then user_id else -1 end as user_id
       from events"""
)
def overlaid_event_maps(spark, sf):
    """Map columns of the events as one; a third has only the first map, half a null in place of the user's."""
    text = lambda c: F.col(c).cast("string")
    base = F.create_map(F.lit("kind"), F.when(F.col("event_id") % 3 == 0, F.lit("own")).otherwise(F.lit("?")))
    over = F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("kind"), "event_type"))
    user = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("user"), text("user_id")))
    both = load(spark, sf, "events").select("event_id", overlay_maps(overlay_maps(base, over), user).alias("m"))
    return both.select("event_id", F.col("m")["kind"].alias("kind"), F.coalesce(F.col("m")["user"].cast("long"), F.lit(-1).cast("long")).alias("user_id"))


@query(
    """with n as (select lang, count(*) as n from documents group by 1), t as (select sum(n) as t from n),
            q as (select unnest(['en', 'fr', 'de']) as lang, unnest([50, 30, 20]) as pct),
            p as (select lang, n / t as p, pct / 100 as q from n left join q using (lang), t)
       select round(sum(p * ln(p / q)), 6) as divergence, round(coalesce(sum(p) filter (where q is null), 0), 6) as untargeted_share from p"""
)
def share_divergence(spark, sf):
    rows = divergence(load(spark, sf, "documents"), "lang", share_table(spark, {"en": 50, "fr": 30, "de": 20}))
    return rows.select(r6(F.col("divergence")).alias("divergence"), r6(F.col("untargeted_share")).alias("untargeted_share"))


@query(
    """with a as (select source as key, count(*) as value from documents group by 1),
            b as (select source as key, count(*) as value from documents join labels using (doc_id) where toxic = 1 group by 1)
       select key, coalesce(b.value, a.value) as value from a full join b using (key)"""
)
def overlaid_settings(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source")
    base = docs.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    toxic = docs.join(load(spark, sf, "labels").where("toxic = 1"), "doc_id")
    return overlay(base, toxic.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("value")))
