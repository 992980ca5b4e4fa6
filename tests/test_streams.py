import datetime as dt

from pyspark.sql import functions as F

from millrace.session import fresh_folder
from millrace.operators.rates import rate_audit
from millrace.streaming import jobs
from millrace.streaming.audits import rate_audit_stream

SCHEMA = "id long, ts timestamp, key string, tok long"
BASE = dt.datetime(2024, 1, 1)


def put(spark, folder, rows):
    data = [(i, BASE + dt.timedelta(seconds=s), k, t) for i, s, k, t in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def open_stream(spark, folder):
    return jobs.event_stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=1)


def test_snapshot_adds_only_new_rows(spark):
    root = fresh_folder(spark, "s")
    put(spark, f"{root}/in", [(1, 0, "a", 1), (2, 1, "b", 1)])
    jobs.append_to(open_stream(spark, f"{root}/in").select("id"), f"{root}/out", f"{root}/progress")
    before = set(spark.read.parquet(f"{root}/out").inputFiles())
    put(spark, f"{root}/in", [(3, 2, "a", 1)])
    jobs.append_to(open_stream(spark, f"{root}/in").select("id"), f"{root}/out", f"{root}/progress")
    after = spark.read.parquet(f"{root}/out")
    assert sorted(r["id"] for r in after.collect()) == [1, 2, 3]
    assert before < set(after.inputFiles())


def test_batch_counts_equal_the_batch_result(spark):
    root = fresh_folder(spark, "c")
    for part in range(3):
        put(spark, f"{root}/in", [(part * 10 + i, i, "ab"[i % 2], i) for i in range(7)])
    jobs.count_batches(open_stream(spark, f"{root}/in"), [F.col("key")], f"{root}/out", f"{root}/progress")
    assert jobs.total_counts(spark, f"{root}/none", ["key"], "key string").count() == 0
    got = {r["key"]: r["n"] for r in jobs.total_counts(spark, f"{root}/out", ["key"], "key string").collect()}
    want = {r["key"]: r["count"] for r in spark.read.parquet(f"{root}/in").groupBy("key").count().collect()}
    assert got == want
    assert spark.read.parquet(f"{root}/out").select("batch").distinct().count() == 3


def test_sliding_totals_equal_the_batch_result_for_closed_windows(spark):
    root = fresh_folder(spark, "w")
    put(spark, f"{root}/in", [(i, i * 7, "ab"[i % 2], 2) for i in range(60)])
    totals = jobs.sliding_totals(open_stream(spark, f"{root}/in"), "ts", ["key"], F.col("tok"))
    got = {tuple(r) for r in spark.read.parquet(jobs.run_to_folder(totals, "w")).collect()}
    batch = spark.read.parquet(f"{root}/in").groupBy(F.window("ts", "60 seconds", "10 seconds"), "key").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("t"))
    closed = batch.where(F.col("window.end") <= F.lit(BASE + dt.timedelta(seconds=59 * 7 - 60)))
    want = {(r[0], r[1], r[2], r[3]) for r in closed.select(F.unix_micros("window.start"), "key", "n", "t").collect()}
    assert got == want and got
    given = spark.createDataFrame(list(got), totals.schema)
    tail = {tuple(r) for r in jobs.open_windows(spark.read.parquet(f"{root}/in"), given, "ts", ["key"], F.col("tok")).collect()}
    every = {(r[0], r[1], r[2], r[3]) for r in batch.select(F.unix_micros("window.start"), "key", "n", "t").collect()}
    assert tail == every - got and tail


def test_first_seen_over_several_batches(spark):
    root = fresh_folder(spark, "d")
    put(spark, f"{root}/in", [(1, 0, "a", 1), (2, 1, "a", 1), (3, 2, "b", 1)])
    put(spark, f"{root}/in", [(4, 60, "a", 1), (5, 61, "c", 1)])
    firsts = jobs.first_seen(open_stream(spark, f"{root}/in"), "ts", ["key"]).select("key")
    assert sorted(r["key"] for r in spark.read.parquet(jobs.run_to_folder(firsts, "d")).collect()) == ["a", "b", "c"]


def test_window_counts_are_corrected_and_replayable(spark):
    root = fresh_folder(spark, "u")
    for k, seconds in enumerate([[0, 10, 4000], [20, 4100], [30, 4200, 90_000]]):
        put(spark, f"{root}/in", [(10 * k + i, s, "ab"[s % 20 == 10], 1) for i, s in enumerate(seconds)])
        jobs.window_counts(open_stream(spark, f"{root}/in"), "ts", ["key"], f"{root}/out", f"{root}/progress", late="2 hours")
    want = {tuple(r) for r in spark.read.parquet(f"{root}/in").groupBy(F.unix_micros(F.window("ts", "1 hour")["start"]), "key").count().collect()}
    latest = lambda: {tuple(r) for r in jobs.latest_counts(spark, f"{root}/out", ["key"], "key string").collect()}
    assert latest() == want
    put(spark, f"{root}/in", [(99, 5, "a", 1), (98, 90_001, "a", 1)])  # too late, and in time
    jobs.window_counts(open_stream(spark, f"{root}/in"), "ts", ["key"], f"{root}/out", f"{root}/progress", late="2 hours")
    hour = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp() + 90_000) // 3600 * 3_600_000_000
    assert latest() == {(s, k, n + (s == hour and k == "a")) for s, k, n in want}
    last = spark.read.schema("start_us long, key string, n long, batch long").parquet(f"{root}/out")
    top = last.agg(F.max("batch")).first()[0]
    again = last.where(F.col("batch") == top).drop("batch").collect()
    spark.createDataFrame(again, "start_us long, key string, n long").write.mode("overwrite").parquet(f"{root}/out/batch={top}")
    assert latest() == {(s, k, n + (s == hour and k == "a")) for s, k, n in want}


def test_first_seen_forgets_what_is_older_than_the_watermark(spark):
    root = fresh_folder(spark, "f")
    for k, rows in enumerate([[("a", 0)], [("b", 10_000)], [("c", 10_001)], [("a", 10_002), ("b", 10_003)]]):
        put(spark, f"{root}/in", [(10 * k + i, s, key, 1) for i, (key, s) in enumerate(rows)])
        firsts = jobs.first_seen(open_stream(spark, f"{root}/in"), "ts", ["key"], "1 hour").select("id", "key")
        jobs.append_to(firsts, f"{root}/out", f"{root}/progress")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").collect()) == [(0, "a"), (10, "b"), (20, "c"), (30, "a")]


def test_stream_audit_equals_the_batch_audit_after_a_restart(spark):
    root = fresh_folder(spark, "a")
    rows = [(i, (i * 37) % 400, ("a", "b", None)[i % 3], i % 5) for i in range(120)] + [(200, 400, "a", None), (201, 400, "a", 3)]

    def run():
        audit = rate_audit_stream(open_stream(spark, f"{root}/in"), ["key"], "ts", "id", F.col("tok"), 60, 3, 9, "500 seconds")
        jobs.append_to(audit, f"{root}/out", f"{root}/progress")
        return audit.schema

    put(spark, f"{root}/in", rows[:50])
    put(spark, f"{root}/in", rows[50:80])
    run()
    put(spark, f"{root}/in", rows[80:])
    run()
    put(spark, f"{root}/in", [(None, 4000, None, None)])  # closes what is open
    schema = run()
    want = rate_audit(spark.createDataFrame([(i, BASE + dt.timedelta(seconds=s), k, t or 0) for i, s, k, t in rows], SCHEMA), ["key"], "ts", "id", F.col("tok"), 60, 3, 9)
    table = lambda df: sorted((str(tuple(r)) for r in df.select("id", "key", "in_window", "tokens_in_window", "rpm_hit", "tpm_hit", "wait_s", "no_history").collect()))
    assert table(spark.read.schema(schema).parquet(f"{root}/out")) == table(want)


def test_stream_audit_runs_in_a_session_with_the_default_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    given = spark.conf.get(key)
    root = fresh_folder(spark, "h")
    rows = [(i, i * 20, "ab"[i % 2], 2) for i in range(12)]
    put(spark, f"{root}/in", rows)
    put(spark, f"{root}/in", [(None, 4000, None, None)])
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        audit = rate_audit_stream(open_stream(spark, f"{root}/in"), ["key"], "ts", "id", F.col("tok"), 60, 3, 9, "500 seconds")
        got = spark.read.schema(audit.schema).parquet(jobs.run_to_folder(audit, "h"))
    finally:
        spark.conf.set(key, given)
    want = rate_audit(spark.createDataFrame([(i, BASE + dt.timedelta(seconds=s), k, t) for i, s, k, t in rows], SCHEMA), ["key"], "ts", "id", F.col("tok"), 60, 3, 9)
    table = lambda df: sorted(str(tuple(r)) for r in df.select("id", "key", "in_window", "tokens_in_window", "rpm_hit", "tpm_hit", "wait_s", "no_history").collect())
    assert table(got) == table(want) and len(table(got)) == 12


def test_stream_audit_deals_many_keys_into_few_groups(spark):
    root = fresh_folder(spark, "b")
    rows = [(i, (i * 37) % 300, None if i % 41 == 0 else f"k{i % 40}", i % 4) for i in range(900)]
    put(spark, f"{root}/in", rows[:500])
    put(spark, f"{root}/in", rows[500:])
    put(spark, f"{root}/in", [(None, 4000, None, None)])
    audit = rate_audit_stream(open_stream(spark, f"{root}/in"), ["key"], "ts", "id", F.col("tok"), 60, 3, 9, "500 seconds", buckets=2)
    query = audit.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(audit.schema).parquet(f"{root}/out")
    want = rate_audit(spark.createDataFrame([(i, BASE + dt.timedelta(seconds=s), k, t) for i, s, k, t in rows], SCHEMA), ["key"], "ts", "id", F.col("tok"), 60, 3, 9)
    table = lambda df: sorted(str(tuple(r)) for r in df.select("id", "key", "in_window", "tokens_in_window", "rpm_hit", "tpm_hit", "wait_s", "no_history").collect())
    assert table(got) == table(want) and len(table(got)) == 900
    state = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    assert max(m.get("numRegisteredTimers", 0) for m in state) <= 2 * 2 * 6  # two buckets, six blocks, two files
