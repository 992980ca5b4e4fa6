"""Streaming jobs over the events file, run once over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import load, query, r6
from millrace.catalog.series import audit_sql
from millrace.session import fresh_folder
from millrace.streaming import jobs
from millrace.streaming.audits import rate_audit_stream


def stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    load(spark, sf, "events")
    rows = jobs.event_stream(spark, sf, schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_id, user_id, event_type, value from events where event_type <> 'error'")
def stream_snapshot(spark, sf):
    kept = stream(spark, sf).where(F.col("event_type") != "error").select("event_id", "user_id", "event_type", "value")
    return spark.read.schema(kept.schema).parquet(jobs.run_to_folder(kept, "snapshot"))


@query(
    """select case when event_type = 'error' then 'failed' when value < 5 then 'too_short' when value > 100 then 'too_long' else 'accepted' end as reason,
              count(*) as n from events group by 1"""
)
def stream_outcome_counts(spark, sf):
    value = F.col("value")
    reason = F.when(F.col("event_type") == "error", "failed").when(value < 5, "too_short").when(value > 100, "too_long").otherwise("accepted")
    root = fresh_folder(spark, "outcomes")
    jobs.count_batches(stream(spark, sf), [reason.alias("reason")], f"{root}/rows", f"{root}/progress")
    return jobs.total_counts(spark, f"{root}/rows", ["reason"], "reason string")


@query(
    """with w as (select user_id, floor(value)::bigint as tok, unnest(range(epoch_us(ts) // 600000000 * 600000000 - 3000000000, epoch_us(ts) // 600000000 * 600000000 + 1, 600000000)) as start_us, epoch_us(ts) as t from events)
       select start_us, user_id, count(*) as requests, sum(tok)::bigint as tokens from w
       where t < start_us + 3600000000 group by 1, 2"""
)
def stream_sliding_totals(spark, sf):
    """Hour-long windows every ten minutes; a batch job adds those still open when the stream ends."""
    shape = (["user_id"], F.floor("value"), "1 hour", "10 minutes")
    totals = jobs.sliding_totals(stream(spark, sf), "ts", *shape)
    closed = spark.read.schema(totals.schema).parquet(jobs.run_to_folder(totals, "sliding"))
    return closed.unionByName(jobs.open_windows(load(spark, sf, "events"), closed, "ts", *shape))


SLICE = 5 * 86_400_000_000


@query(
    f"""with recursive d as (select distinct event_type, user_id, epoch_us(ts) // {SLICE} * {SLICE} as slice_us from events),
              r as (select slice_us, lag(slice_us) over (order by slice_us) as before_us from (select distinct slice_us from d)),
              f as (select event_type, user_id, min(slice_us) as slice_us from d group by 1, 2
                    union all
                    select f.event_type, f.user_id, min(d.slice_us) from f join d using (event_type, user_id) join r on r.slice_us = d.slice_us
                    where r.before_us > f.slice_us + 518400000000 group by f.event_type, f.user_id, f.slice_us)
       select event_type, user_id, slice_us from f"""
)
def stream_first_seen(spark, sf):
    """A run for each five days, event times cut to them, with a watermark of three days: a pair that is
    away for longer than state lives (twice the watermark) is given out again."""
    root = fresh_folder(spark, "first-seen")
    events = load(spark, sf, "events")
    slices = events.select("event_type", "user_id", F.timestamp_micros(F.expr(f"unix_micros(ts) div {SLICE} * {SLICE}")).alias("ts"))
    for at in sorted(r["ts"] for r in slices.select("ts").distinct().collect()):  # one value for each five days
        slices.where(F.col("ts") == F.lit(at)).write.mode("append").parquet(f"{root}/in")
        firsts = jobs.first_seen(jobs.event_stream(spark, f"{root}/in", slices.schema), "ts", ["event_type", "user_id"], "3 days")
        jobs.append_to(firsts.select("event_type", "user_id", F.unix_micros("ts").alias("slice_us")), f"{root}/out", f"{root}/progress")
    return spark.read.schema("event_type string, user_id long, slice_us long").parquet(f"{root}/out")


@query(audit_sql("user_id", 86_400, 3, 100))
def stream_rate_audit(spark, sf):
    """The audit of `rate_audit` over files that arrive one after another, the last one a sign of life that closes all windows."""
    root = fresh_folder(spark, "audit")
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", F.floor("value").alias("tok"))
    events.repartitionByRange(3, "ts").write.parquet(f"{root}/in")
    end = events.agg(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 40 days")).alias("ts"), F.lit(None).cast("long").alias("tok"))
    end.write.mode("append").parquet(f"{root}/in")
    rows = jobs.event_stream(spark, f"{root}/in", events.schema, per_trigger=3)
    audit = rate_audit_stream(rows, ["user_id"], "ts", "event_id", F.col("tok"), 86_400, 3, 100, "31 days")
    done = spark.read.schema(audit.schema).parquet(jobs.run_to_folder(audit, "audited"))
    return done.drop("user_id").withColumn("wait_s", r6(F.col("wait_s")))


@query("select epoch_us(ts) // 86400000000 * 86400000000 as start_us, event_type, count(*) as n from events group by 1, 2")
def stream_window_counts(spark, sf):
    """Counts per day and kind of event in update mode, over files that arrive one after another."""
    root = fresh_folder(spark, "arrivals")
    events = load(spark, sf, "events").select("event_id", "ts", "event_type")
    events.repartitionByRange(3, "ts").write.parquet(f"{root}/in")
    rows = jobs.event_stream(spark, f"{root}/in", events.schema, per_trigger=1)
    jobs.window_counts(rows, "ts", ["event_type"], f"{root}/out", f"{root}/progress", "1 day", "60 days")
    return jobs.latest_counts(spark, f"{root}/out", ["event_type"], "event_type string")
