import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import allocate, ledger, lookups, rolling
from millrace.operators.bounds import settle
from millrace.operators.joins import attach
from millrace.sources.tables import from_records
from millrace.operators.cuts import exact_split, take_quota
from millrace.operators.ordered import framed, group_extent

# Shares in percent.
LANGUAGES = {"python": 40, "javascript": 25, "java": 15, "cpp": 10, "go": 5, "rust": 5}
LEVELS = {"easy": 30, "medium": 50, "hard": 20}


def test_usage_worked_values(spark):
    rows = [(True, 625, 0.0625)] * 8 + [(False, 999, 9.0)] * 2
    df = spark.createDataFrame(rows, "ok boolean, tok long, cost double")
    r = ledger.usage_totals(df, F.col("ok"), F.col("tok"), F.col("cost")).first()
    assert (r["total_requests"], r["failed_requests"], r["success_rate"]) == (10, 2, 0.8)
    assert (r["average_tokens_per_request"], r["average_cost_per_request"]) == (500, pytest.approx(0.05))
    empty = ledger.usage_totals(df.where("false"), F.col("ok"), F.col("tok"), F.col("cost")).first()
    assert (empty["total_requests"], empty["success_rate"], empty["total_cost"]) == (0, 0, 0)


def test_cost(spark):
    df = spark.createDataFrame([(1000, 500)], "i long, o long")
    assert df.select(ledger.token_cost(F.col("i"), F.col("o"))).first()[0] == pytest.approx(0.0525)


def test_dataset_totals(spark):
    df = spark.createDataFrame([("python", 100, 1.0), ("python", 110, 1.5), ("go", 120, 2.0)], "lang string, tok long, sec double")
    got = {r["lang"]: r for r in ledger.dataset_totals(df, "lang", F.col("tok"), F.col("sec")).collect()}
    assert got[None]["average_tokens"] == 110 and got[None]["total_tokens"] == 330 and got[None]["average_time"] == 1.5
    assert got["python"]["total_examples"] == 2
    assert ledger.dataset_totals(df.where("false"), "lang", F.col("tok"), F.col("sec")).count() == 0


def test_completion(spark):
    counts = from_records(spark, [(80,)], "accepted long")
    usage = from_records(spark, [(120, 4.0)], "total_requests long, total_cost double")
    r = ledger.completion(counts, usage, 100).first()
    assert (r["completion_rate"], r["total_api_calls"], r["average_cost_per_example"]) == (0.8, 120, 0.05)


def test_pairing_keeps_every_request(spark):
    asks = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    answers = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, "c")], "k long, pos long, text string")
    got = {r["k"]: (r["success"], r["error"], r["response"] and r["response"]["text"]) for r in ledger.paired(asks, answers, "k", "pos", ["text"]).collect()}
    assert got == {1: (True, None, "a"), 2: (False, "no response", None), 3: (True, None, "c")}


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_batches(spark, limit):
    df = spark.range(25).withColumn("k", F.lit("x"))
    got = ledger.batches(df, ["k"], [F.col("id")], 10, limit=limit).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 10), (1, 10), (2, 5)]


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_spend_alerts(spark, limit):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", i, base + dt.timedelta(hours=i), 100.0) for i in range(6)] + [("b", 9, base, 10.0)]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp, v double")
    got = {r["k"]: tuple(r)[1:] for r in ledger.spend_alerts(df, "k", "ts", "id", F.col("v").cast("decimal(18,6)"), limit=limit).collect()}
    assert got["a"] == (600, 3, 4) and got["b"] == (10, None, None)


def test_option_or_keeps_zero(spark):
    df = spark.createDataFrame([(0,), (None,)], "v long")
    assert [r[0] for r in df.select(ledger.option_or(F.col("v"), 5)).collect()] == [0, 5]


def test_quota_grid(spark):
    def grid(n, mode="floor"):
        rows = allocate.quota_grid(from_records(spark, [(n,)], "target long"), LANGUAGES, LEVELS, mode=mode)
        return {(r["language"], r["difficulty"]): r["quota"] for r in rows.collect()}

    big = grid(25_000)
    assert [big["python", d] for d in ("easy", "medium", "hard")] == [3000, 5000, 2000] and sum(big.values()) == 25_000
    small = grid(10)
    assert [small["python", d] for d in ("easy", "medium", "hard")] == [1, 2, 0] and sum(small.values()) <= 10
    assert sum(grid(10, "largest_remainder").values()) == 10
    assert sum(grid(1013, "largest_remainder").values()) == 1013


def test_units(spark):
    quotas = from_records(spark, [("a", 0), ("b", 7), ("c", 2)], "k string, quota long")
    got = sorted(tuple(r) for r in allocate.quota_units(quotas, ["k"], chunk=3).collect())
    assert got == [("b", i) for i in range(1, 8)] + [("c", 1), ("c", 2)]


def test_total_quota(spark):
    df = spark.createDataFrame([({"python": {"easy": 3, "hard": 2}, "go": {"easy": 1}},)], "quotas map<string,map<string,long>>")
    assert allocate.total_quota(df).first()["total"] == 6


def test_lookup_fallbacks(spark):
    df = spark.createDataFrame([(1, "en", "easy"), (2, "xx", "easy"), (3, "en", "hard")], "id long, language string, difficulty string")
    table = lookups.template_table(spark, {"en": {"easy": ["T {task}"], "hard": []}})
    got = {r["id"]: r["template"] for r in lookups.with_template(df, table, ["F {language} {task}"], "id", 1).collect()}
    assert got == {1: "T {task}", 2: "F xx {task}", 3: "F en {task}"}
    tasked = lookups.with_task(df, {"easy": ["c"]}, ["none"], lookups.task_table(spark, {"c": ["x"]}), "fallback", "id", 1)
    assert {r["id"]: r["task"] for r in tasked.collect()} == {1: "x", 2: "x", 3: "fallback"}


def test_overlay(spark):
    a = from_records(spark, [("x", "1"), ("y", "2"), ("w", "9")], "key string, value string")
    b = from_records(spark, [("y", "3"), ("z", "4"), ("w", None)], "key string, value string")
    assert {tuple(r) for r in lookups.overlay(a, b).collect()} == {("x", "1"), ("y", "3"), ("z", "4"), ("w", None)}
    maps = spark.createDataFrame([({"x": 1, "y": 2}, {"y": 3})], "a map<string,int>, b map<string,int>")
    assert maps.select(lookups.overlay_maps(F.col("a"), F.col("b"))).first()[0] == {"x": 1, "y": 3}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_crowded_keys(spark, how):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")))
    dim = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = {tuple(r) for r in df.join(dim, "k", how).select("id", "k", "v").collect()}
    got = attach(df, dim, ["k"], how, spread=["id"], small=10, hot=100)
    assert {tuple(r) for r in got.select("id", "k", "v").collect()} == want
    assert got.count() == len(want) and set(got.columns) == {"id", "k", "v"}


@pytest.mark.parametrize("rows,want", [(3, True), (2, False)])
def test_settle_counts_rows(spark, rows, want):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, None), (3, "c", [])], "id long, s string, a array<int>")
    table, small = settle(df, rows)
    assert small is want and table.schema == df.schema
    assert sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
    assert settle(df.where("false"))[1] and settle(df.where("false"))[0].count() == 0


@pytest.mark.parametrize("value", ["x" * 2000, "é" * 600])
def test_settle_looks_at_width(spark, value):
    df = spark.createDataFrame([(1, value)], "id long, s string")
    table, small = settle(df, size=1_000)
    assert not small and table.first()["s"] == value
    nested = df.select("id", F.array("s").alias("a"))
    assert not settle(nested, size=1_000)[1] and settle(nested)[1]


@pytest.mark.parametrize("limit", [1_000_000, 4])
def test_adaptive_clip_needs_eleven(spark, limit):
    df = spark.createDataFrame([(i, 1.0 if i < 11 else 100.0) for i in range(12)], "id long, v double").withColumn("k", F.lit(1))
    got = {r["id"]: r for r in rolling.adaptive_clip(df, ["k"], [F.col("id")], "v", limit=limit).collect()}
    assert all(got[i]["threshold"] is None for i in range(10)) and got[10]["threshold"] == 1.0
    values = [1.0] * 11 + [100.0]
    mean = sum(values) / 12
    line = mean + 2 * (sum((x - mean) ** 2 for x in values) / 12) ** 0.5
    assert got[11]["threshold"] == pytest.approx(line) and got[11]["is_clipped"] and got[11]["clipped"] == pytest.approx(line)


def test_scale_to_norm(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 4.0), ("b", 3, 0.5), ("z", 4, 0.0)], "k string, id long, v double")
    got = {r["id"]: r["scaled"] for r in rolling.scale_to_norm(df, ["k"], "v", "id", 1.0).collect()}
    assert got == {1: pytest.approx(0.6), 2: pytest.approx(0.8), 3: 0.5, 4: 0.0}


def test_a_null_mask_ignores_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, "c"), ("a", 9.0, "x")], "k string, v double, c string")
    r = rolling.weighted_mean(df, ["k"], F.col("v"), F.col("c") == "i", F.col("c") == "x").first()
    assert (r["weighted_mean"], r["rows_used"]) == (2.0, 2)


def test_a_null_map_counts_as_empty(spark):
    df = spark.createDataFrame([({"x": 1}, None), (None, {"y": 2}), (None, None), ({}, {"z": 3})], "a map<string,int>, b map<string,int>")
    got = [r[0] for r in df.select(lookups.overlay_maps(F.col("a"), F.col("b"))).collect()]
    assert got == [{"x": 1}, {"y": 2}, None, {"z": 3}]


def test_weighted_mean_divides_by_rows(spark):
    df = spark.createDataFrame([(1.0, "i"), (2.0, "n"), (9.0, "x")], "v double, c string").withColumn("k", F.lit(1))
    c = F.col("c")
    r = rolling.weighted_mean(df, ["k"], F.col("v"), c == "i", c == "x").first()
    assert (r["weighted_mean"], r["rows_used"]) == (2.0, 2)


def test_divergence(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "lang string")
    target = lookups.share_table(spark, {"a": 75, "b": 25, "c": 0})
    assert rolling.divergence(df, "lang", target).first()["divergence"] == pytest.approx(0)
    import math

    half = rolling.divergence(df, "lang", lookups.share_table(spark, {"a": 50})).first()
    assert half["divergence"] == pytest.approx(0.75 * math.log(1.5)) and half["untargeted_share"] == 0.25


def test_age_weights(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 10), ("a", 3, 10), ("b", 4, 5), (None, 5, 0), (None, 6, 20), ("c", 7, None)], "k string, id long, s long")
    rows = rolling.age_weights(df.withColumn("ts", F.timestamp_seconds("s")), ["k"], "ts", 10)
    got = {r["id"]: r["weight"] for r in rows.collect()}
    want = {1: 0.2, 2: 0.4, 3: 0.4, 4: 1.0, 5: 0.2, 6: 0.8}
    assert got == {**{i: pytest.approx(w) for i, w in want.items()}, 7: None}
    assert rolling.age_weights(df.limit(0).withColumn("ts", F.timestamp_seconds("s")), ["k"], "ts", 10).count() == 0


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, 1, 3.0), (None, 2, 4.0), ("b", 3, 0.5)], "k string, id long, v double")
    got = {r["id"]: r["scaled"] for r in rolling.scale_to_norm(df, ["k"], "v", "id", 1.0).collect()}
    assert got == {1: pytest.approx(0.6), 2: pytest.approx(0.8), 3: 0.5}
    a = spark.createDataFrame([(None, "1"), ("x", "2")], "key string, value string")
    b = spark.createDataFrame([(None, "3")], "key string, value string")
    assert {tuple(r) for r in lookups.overlay(a, b).collect()} == {(None, "3"), ("x", "2")}
    quotas = spark.createDataFrame([(None, 1), ("b", 5)], "k string, quota long")
    assert [r["k"] for r in take_quota(df, ["k"], quotas, "id").orderBy("k").collect()] == [None, "b"]
    short = {r["k"]: (r["delivered"], r["shortfall"]) for r in allocate.shortfall(df, ["k"], quotas).collect()}
    assert short == {None: (2, -1), "b": (1, 4)}
    full = {r["k"]: r["capacity"] for r in allocate.capacity(df.withColumn("t", F.col("id").cast("string")), ["k"], "t", quotas).collect()}
    assert full == {None: 2, "b": 1}


def test_a_crowded_null_key_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(4000).withColumn("k", F.when(F.col("id") % 10 == 0, F.col("id")))
        dim = spark.range(0, 4000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        rows = attach(df, dim, ["k"], "left", spread=["id"], small=10, hot=100)
        sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_null_id_has_a_place_in_the_split(spark):
    df = spark.createDataFrame([(i if i else None,) for i in range(20)], "id long")
    parts = [r["split"] for r in exact_split(df, "id").collect()]
    assert (parts.count("train"), parts.count("validation"), parts.count("test")) == (16, 2, 2)


def test_wide_rows_count_by_their_bytes(spark):
    df = spark.createDataFrame([(1, i, "x" * 1280) for i in range(6)], "k int, id int, t string")
    assert group_extent(df, ["k"]) == (6, 6) and group_extent(df, ["k"], ["t"]) == (60, 60)
    lag = lambda w: {"before": F.lag("id").over(w)}
    for limit in (100, 30):
        got = framed(df, ["k"], [F.col("id")], lag, back=1, limit=limit, wide=["t"])
        assert sorted((r["id"], r["before"]) for r in got.collect()) == [(i, i - 1 if i else None) for i in range(6)]
