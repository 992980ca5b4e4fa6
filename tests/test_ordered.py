"""The wide way must give what one window per key gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.ordered import framed, group_extent, numbered, running


@pytest.fixture(scope="module")
def series(spark):
    """One key holds a third of the rows, one key is null, times repeat."""
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"k{rng.randrange(40)}")
        data.append((i, key, rng.randrange(60), rng.randrange(100), None if i % 11 == 0 else rng.randrange(50)))
    return spark.createDataFrame(data, "id long, key string, t long, v long, m long").repartition(5)


def by_time():
    return [F.col("t"), F.col("id")]


def pairs(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for c in [0] for r in df.collect()}


def test_extent(series):
    widest, total = group_extent(series, ["key"])
    assert (widest, total) == (300, 900)
    assert group_extent(series.where("false"), ["key"]) == (0, 0)
    assert group_extent(series, []) == (900, 900)


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("limit", [7, 50])
def test_numbered(series, keys, limit):
    plain, wide = numbered(series, keys, by_time()), numbered(series, keys, by_time(), limit=limit)
    assert pairs(plain, "rn") == pairs(wide, "rn")
    assert set(plain.columns) == set(wide.columns)


def test_numbered_descending(series):
    order = [F.col("v").desc(), F.col("id")]
    assert pairs(numbered(series, ["key"], order), "rn") == pairs(numbered(series, ["key"], order, limit=9), "rn")


@pytest.mark.parametrize("keys", [["key"], []])
def test_running(series, keys):
    args = dict(sums={"s": F.col("v"), "sm": F.col("m")}, maxima={"x": F.col("m")})
    plain, wide = running(series, keys, by_time(), **args), running(series, keys, by_time(), **args, limit=8)
    assert pairs(plain, "s", "sm", "x") == pairs(wide, "s", "sm", "x")


@pytest.mark.parametrize("back,ahead", [(9, 0), (1, 0), (0, 1), (1, 2), (40, 0)])
@pytest.mark.parametrize("keys", [["key"], []])
def test_framed(series, keys, back, ahead):
    def make(w):
        frame = w.rowsBetween(-back, ahead)
        return {"n": F.count(F.lit(1)).over(frame), "s": F.sum("v").over(frame), "lo": F.min("t").over(frame)}

    plain = framed(series, keys, by_time(), make, back, ahead)
    wide = framed(series, keys, by_time(), make, back, ahead, limit=13)
    assert pairs(plain, "n", "s", "lo") == pairs(wide, "n", "s", "lo")
    assert wide.count() == 900


def test_wide_tasks_stay_small(series):
    """No window task of the wide way is handed the crowded key as a whole."""
    wide = numbered(series, ["key"], by_time(), limit=30)
    assert wide.where("key = 'hot'").count() == 300
    from millrace.operators.ordered import _runs

    runs = _runs(series, ["key"], by_time(), 900, 30)
    widest = runs.groupBy("key", "__run").count().agg(F.max("count")).first()[0]
    assert widest <= 90


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_partition_count_does_not_matter(spark, series, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {r["id"]: r["rn"] for r in series.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*by_time()))).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["id"]: r["rn"] for r in numbered(series, ["key"], by_time(), limit=20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
