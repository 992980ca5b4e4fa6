import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, rules
from millrace.plans.curation import accepted_rows


@pytest.fixture(scope="module")
def copies(spark):
    texts = ["Count the red boxes", "COUNT THE RED BOXES", " count the red boxes\n", "another"]
    return spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "id long, text string")


@pytest.mark.parametrize("small", [100_000, 0])
def test_smallest_id_stays(copies, small):
    got = {r["id"] for r in dedup.drop_copies(copies, "text", "id", small=small).collect()}
    assert got == {8, 7}
    again = dedup.drop_copies(dedup.drop_copies(copies, "text", "id", small=small), "text", "id", small=small)
    assert {r["id"] for r in again.collect()} == got


@pytest.mark.parametrize("small", [100_000, 0])
def test_a_third_of_all_rows_are_one_text(spark, small):
    df = spark.range(3000).withColumn("text", F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))))
    kept = dedup.drop_copies(df, "text", "id", small=small)
    assert kept.count() == 2001 and kept.where("text = 'same'").first()["id"] == 0


@pytest.mark.parametrize("least,most", [(1 << 20, 1 << 28), (1 << 6, 1 << 6), (1 << 15, 1 << 16)])
def test_membership_filter_of_any_size_gives_the_same_rows(spark, monkeypatch, least, most):
    """Also a full one; and the plan takes no unrepeated text through a shuffle."""
    monkeypatch.setattr(dedup, "LEAST_BITS", least)
    monkeypatch.setattr(dedup, "MOST_BITS", most)
    df = spark.range(4000).withColumn("text", F.concat(F.lit("t"), F.when(F.col("id") % 4 == 0, F.col("id") % 100).otherwise(F.col("id")), F.col("id") % 4))
    want = {r["id"] for r in dedup.drop_copies(df, "text", "id").collect()}
    kept = dedup.drop_copies(df, "text", "id", small=0)
    assert {r["id"] for r in kept.collect()} == want and kept.count() == len(want) == 3025
    keys = df.where("id % 7 = 0").select("text")
    held = dedup.membership(keys, "text", dedup.filter_bits(keys.count()))
    slot = dedup.slot_of(F.col("text"), dedup.filter_bits(keys.count()))
    met = df.withColumn("s", slot).join(held, F.bitmap_bucket_number("s") == F.col("__bucket"), "left").where(F.coalesce(dedup.bit_set(F.col("__bits"), F.col("s")), F.lit(False)))
    assert keys.join(met, "text", "left_anti").count() == 0
    assert least < 1 << 20 or met.count() < 2000


def test_null_texts_are_one_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, text string")
    assert dedup.first_ids(df, "text", "id").count() == 2


def test_incremental(copies):
    seen = dedup.first_ids(copies.where("id = 9"), "text", "id").select("key")
    assert {r["id"] for r in dedup.drop_seen(copies, "text", "id", seen).collect()} == {7}
    assert dedup.drop_seen(copies, "text", "id", seen.where("false")).count() == 2


def test_length_bounds(spark):
    sizes = [49, 50, 2048, 2049]
    df = spark.createDataFrame([(n, "  " + "x" * n + "\n") for n in sizes], "n long, text string")
    got = {r["n"]: r["r"] for r in df.select("n", rules.reject_reason(F.col("text")).alias("r")).collect()}
    assert got == {49: "too_short", 50: "accepted", 2048: "accepted", 2049: "too_long"}
    assert df.where(rules.length_within(F.col("text"))).count() == 2


def test_first_failing_rule_counts(spark):
    df = spark.createDataFrame(
        [(1, "x", "en", False), (2, "x", "en", True), (3, "y" * 60, "en", True), (4, "y" * 60, "fr", True)],
        "id long, text string, lang string, ok boolean",
    )
    rule = (F.col("lang") == "en", F.contains(F.col("text"), F.lit("z")))
    reason = rules.reject_reason(F.col("text"), success=F.col("ok"), class_rule=rule)
    got = {r["id"]: r["r"] for r in df.select("id", reason.alias("r")).collect()}
    assert got == {1: "failed", 2: "too_short", 3: "syntax", 4: "accepted"}


def test_missing_values_do_not_pass(spark):
    df = spark.createDataFrame([(1, None, True), (2, "y" * 60, None), (3, "y" * 60, True)], "id long, text string, ok boolean")
    rule = (F.lit(True), F.when(F.col("id") != 3, F.lit(True)))
    reason = rules.reject_reason(F.col("text"), success=F.col("ok"), class_rule=rule)
    assert [r["r"] for r in df.orderBy("id").select(reason.alias("r")).collect()] == ["too_short", "failed", "syntax"]


def test_parser_runs_last(spark):
    good = "def hello():\n    return 'a value that is long enough to pass the rule'\n"
    df = spark.createDataFrame([(1, good, True), (2, good + "def (", True), (3, good + "def (", False), (4, "def (", True)], "id long, text string, code boolean")
    got = {r["id"]: r["reason"] for r in rules.with_code_check(df, "text", F.col("code")).collect()}
    assert got == {1: "accepted", 2: "syntax", 3: "accepted", 4: "too_short"}


def test_rates(spark):
    counts = spark.createDataFrame([(110, 10, 100, 0, 8, 2, 80)], "candidates long, duplicates_removed long, total_generated long, failed long, quality_filtered long, syntax_errors long, accepted long")
    r = dedup.outcome_rates(counts).first()
    assert (r["acceptance_rate"], r["duplicate_rate"], r["quality_filter_rate"], r["syntax_error_rate"]) == (0.8, 0.1, 0.08, 0.02)
    assert r["duplicate_share"] == pytest.approx(10 / 110)
    empty = dedup.outcome_rates(counts.withColumn("total_generated", F.lit(0).cast("long"))).first()
    assert empty["acceptance_rate"] is None and empty["accepted"] == 80


def test_outcome_counts(spark):
    df = spark.createDataFrame([(1, "a", "accepted"), (2, "A ", "accepted"), (3, "b", "too_short"), (4, "c", "syntax"), (5, "d", "failed")], "id long, text string, reason string")
    r = dedup.outcome_counts(df, "text", "id", "reason").first().asDict()
    assert r == {"candidates": 5, "duplicates_removed": 1, "total_generated": 4, "failed": 1, "quality_filtered": 1, "syntax_errors": 1, "accepted": 1}


def test_examples(spark):
    df = spark.createDataFrame([("do", "done", True), ("try", "", False)], "ask string, answer string, success boolean")
    got = rules.as_examples(rules.keep_successful(df), "ask", "answer").collect()
    assert [tuple(r) for r in got] == [("do", "", "done")]


def test_accepted_rows_reads_texts_once(spark):
    df = spark.createDataFrame([(2, "A" * 60, "en"), (1, "a" * 60 + " ", "fr"), (3, "short", "en")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in accepted_rows(df).collect()] == [(1, "fr", 60)]
