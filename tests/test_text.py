import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as tx


def test_white_space_is_complete():
    known = {c for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    assert known == set(tx.SPACE_CODES)


def test_pattern_is_the_same_set(spark):
    chars = spark.createDataFrame([(c, chr(c)) for c in range(1, 0xD800)], "id long, s string")
    got = {r["id"] for r in chars.where(F.rlike("s", F.lit("^" + tx.SPACE_RUN + "$"))).collect()}
    assert got == set(tx.SPACE_CODES)


SAMPLES = ["", "  ", "\n a b \t", " x ", "one", "a　b  c\n", "\x1cq\x1f", "É à", " (Base) x"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "id long, s string")


def column(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_strip_normalise_words(texts):
    s = F.col("s")
    assert column(texts, tx.strip(s)) == [x.strip() for x in SAMPLES]
    assert column(texts, tx.normalise(s)) == [x.lower().strip() for x in SAMPLES]
    assert column(texts, tx.words(s)) == [x.split() for x in SAMPLES]
    assert column(texts, tx.first_word(s, "?")) == [(x.split() or ["?"])[0] for x in SAMPLES]
    assert column(texts, tx.last_word(s, "?")) == [(x.split() or ["?"])[-1] for x in SAMPLES]
    assert column(texts, tx.token_estimate(s)) == [len(x) // 4 for x in SAMPLES]
    assert column(texts, tx.file_key(s)) == [x.replace(" ", "_").replace("(", "").replace(")", "") for x in SAMPLES]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from("ab# \n\t  é"), max_size=30), min_size=1, max_size=40))
def test_lines_and_comments(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id long, s string")
    s = F.col("s")
    assert column(df, tx.line_count(s)) == [len(v.split("\n")) for v in values]
    want = [sum(1 for line in v.split("\n") if line.strip().startswith("#")) for v in values]
    assert column(df, tx.comment_lines(s)) == want
    assert column(df, tx.strip(s)) == [v.strip() for v in values]


def test_fill_slots(spark):
    df = spark.createDataFrame([(0, "Do {task}, {problem}; {concept}/{algorithm} and {features}", "merge sort")], "id long, t string, k string")
    got = column(df, tx.fill_slots(F.col("t"), tx.task_slots(F.col("k"))))
    assert got == ["Do merge sort, merge sort; sort/merge and advanced merge sort"]


def test_assertions(spark):
    lines = ["assert f(1) == 2", "assert f(1)", "assert a == b == c", "f(1) == 2", "assert g('x')  == 'y' "]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, s string")
    got = [None if p is None else tuple(p) for p in column(df, tx.assertion_parts(F.col("s")))]
    assert got == [("f(1)", "2"), None, None, None, ("g('x')", "'y'")]


def test_drop_prefix(spark):
    df = spark.createDataFrame([(0, "head  tail ", "head"), (1, "ab", "abcd")], "id long, s string, p string")
    assert column(df, tx.drop_prefix(F.col("s"), F.col("p"))) == ["tail", ""]


def test_score_text_rounds_like_printf(spark):
    values = [0.8125, 0.0125, 0.0875, 1 / 3, 1.0, 0.0, 0.0625, 2 / 3, 0.8135] + [k / 80 for k in range(81)] + [k / 400 for k in range(401)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    assert column(df, tx.score_text(F.col("v"))) == [f"{v:.3f}" for v in values]


def test_record_rendering(spark):
    df = spark.createDataFrame([(0, "c", "documented"), (1, None, "clean"), (2, "", "optimized")], "id long, ctx string, style string")
    got = column(df, tx.render_record([F.lit("H")], F.col("ctx"), F.col("style"), {"documented": "- d", "optimized": "- o"}, F.lit("end")))
    assert got == ["H\n\nContext: c\n- d\n\nend", "H\n\nend", "H\n- o\n\nend"]


def test_first_match_is_ordered(spark):
    df = spark.createDataFrame([(0, "XgptLLAMA"), (1, "gpt-x"), (2, "other")], "id long, s string")
    rules = [(("llama",), "one"), (("GPT",), "two")]
    assert column(df, tx.first_match(F.col("s"), rules, "none")) == ["one", "two", "none"]


def test_slots_are_filled_in_one_pass(spark):
    df = spark.createDataFrame([("Do {task}", "parse {problem} and {concept}"), ("{{task}} {other} {", "x"), ("}} {task}", None), ("plain", None), (None, "x")], "t string, v string")
    got = [r[0] for r in df.select(tx.fill_slots(F.col("t"), {"task": F.col("v"), "problem": F.lit("P"), "concept": F.lit("C")})).collect()]
    assert got == ["Do parse {problem} and {concept}", "{task} {other} {", None, "plain", None]


def test_edge_words_and_comment_lines_take_no_text_apart(spark):
    texts = ["", " \u00a0\n", "one", "\x1c a\u2003b\n c ", "#a\n  # b\n\u2003#c\nx # d\r\n\t#e\n#", "x\r#y\n\n#", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = df.select(tx.first_word(c, "-"), tx.last_word(c, "+"), tx.comment_lines(c)).collect()
    want = []
    for t in texts:
        words = (t or "").split()
        lines = None if t is None else sum(line.strip().startswith("#") for line in t.split("\n"))
        want.append((words[0] if words else "-", words[-1] if words else "+", lines))
    assert [tuple(r) for r in rows] == want
    assert "lambda" not in df.select(tx.first_word(c, "-"), tx.last_word(c, "+"), tx.comment_lines(c))._jdf.queryExecution().toString()
