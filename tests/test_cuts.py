import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.draws import draw32, pick, shuffle_key, uniform, weighted_choice
from millrace.operators.cuts import exact_split, take_quota
from millrace.sources.tables import from_records


@pytest.mark.parametrize("n,want", [(10, (8, 1, 1)), (11, (8, 1, 2)), (99, (79, 9, 11)), (100, (80, 10, 10)), (1, (0, 0, 1)), (0, (0, 0, 0))])
def test_split_sizes(spark, n, want):
    parts = exact_split(spark.range(n), "id").groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in parts}
    assert tuple(sizes.get(s, 0) for s in ("train", "validation", "test")) == want


def test_split_follows_the_seeded_order(spark):
    rows = exact_split(spark.range(5000), "id", seed=9).withColumn("k", shuffle_key(9, F.col("id")))
    listed = [r["split"] for r in rows.orderBy("k", "id").collect()]
    assert listed == ["train"] * 4000 + ["validation"] * 500 + ["test"] * 500
    other = exact_split(spark.range(5000), "id", seed=10).where("split = 'train'")
    assert other.join(rows.where("split = 'train'"), "id").count() not in (0, 4000)


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_split_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {tuple(r) for r in exact_split(spark.range(777), "id").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {tuple(r) for r in exact_split(spark.range(777).repartition(13), "id").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quota_against_one_window_per_stratum(spark):
    df = spark.range(6000).withColumn("lang", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 7)))
    quotas = from_records(spark, [("hot", 777), ("l1", 50), ("l2", 10_000), ("l3", 0), ("none", 5)], "lang string, quota long")
    got = {r["id"] for r in take_quota(df, ["lang"], quotas, "id").collect()}
    w = Window.partitionBy("lang").orderBy(shuffle_key(42, F.col("id")), "id")
    plain = df.withColumn("rn", F.row_number().over(w)).join(quotas, "lang").where("rn <= quota")
    assert got == {r["id"] for r in plain.collect()}


def test_draws_are_fixed(spark):
    one = spark.range(1, 2)
    assert one.select(draw32(42, F.col("id"))).first()[0] == 1494077868
    us = [r[0] for r in spark.range(2000).select(uniform(1, F.col("id"))).collect()]
    assert 0 <= min(us) and max(us) < 1 and 0.45 < sum(us) / len(us) < 0.55


def test_pick(spark):
    df = spark.range(300).select(pick(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, F.col("id")).alias("p"), pick(F.array().cast("array<string>"), 1, F.col("id")).alias("q"))
    got = df.collect()
    assert {r["p"] for r in got} == {"a", "b", "c"} and {r["q"] for r in got} == {None}


def test_weighted_choice_follows_its_shares(spark):
    counts = spark.range(10_000).groupBy(weighted_choice({"x": 50, "y": 30, "z": 20}, 3, F.col("id")).alias("c")).count()
    got = {r["c"]: r["count"] / 10_000 for r in counts.collect()}
    assert got["x"] == pytest.approx(0.5, abs=0.02) and got["z"] == pytest.approx(0.2, abs=0.02)
