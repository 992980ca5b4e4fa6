import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as ar
from millrace.functions.code import branching, compiles, parse_state, syntax_facts

MIX = '''"""module"""
# c
def f(x):
    """doc"""
    if x:
        for i in x:
            while i:
                break
    try:
        with open(x) as h:
            pass
    except OSError:
        pass
'''
CODES = [(0, "def hello():\n    return 1\n"), (1, "def hello("), (2, "return 1"), (3, ""), (4, MIX), (5, "x = '\x00'"), (6, "(" * 5000)]


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame(CODES, "id long, code string")


def test_two_grammars(code):
    got = {r["id"]: (r["c"], r["p"]["ok"], r["p"]["error"]) for r in code.select("id", compiles(F.col("code")).alias("c"), parse_state(F.col("code")).alias("p")).collect()}
    assert got[0] == (True, True, None)
    assert got[1][:2] == (False, False) and got[1][2].startswith("Syntax Error")
    assert got[2][:2] == (False, True)
    assert got[3][:2] == (True, True)
    assert got[4][:2] == (True, True)
    assert got[5][:2] == (False, False) and got[6][:2] == (False, False)


def test_syntax_facts(code):
    got = {r["id"]: r for r in code.select("id", syntax_facts(F.col("code")).alias("f")).select("id", "f.*", branching(F.col("f.nodes")).alias("b")).collect()}
    assert got[4]["b"] == 5 and got[4]["docstrings"] == 2 and got[4]["nodes"]["FunctionDef"] == 1
    assert got[0]["b"] == 0 and got[0]["docstrings"] == 0
    assert got[1]["b"] is None and got[1]["nodes"] is None


def test_null_code_is_not_parsed(spark):
    df = spark.createDataFrame([(1, None)], "id long, code string")
    assert df.select(compiles(F.col("code"))).first()[0] is True


def test_fixed_width(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a"]), (2, [])], "id long, t array<string>").orderBy("id")
    got = df.select(ar.fit_length(F.col("t"), 2, "_"), ar.presence_mask(F.col("t"), 2)).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], [1, 1]), (["a", "_"], [1, 0]), (["_", "_"], [0, 0])]
    masked = df.select(ar.mask_first(F.array(F.lit(7), F.lit(8), F.lit(9)), F.lit(2))).first()[0]
    assert masked == [-100, -100, 9]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0, 5.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(ar.norm(a), ar.mean_squared_gap(a, b), ar.squared_gap(b, a)).first()
    assert r[0] == 5 and r[1] == pytest.approx((4 + 9) / 2) and r[2] == 13
    assert math.isclose(df.select(ar.squared_norm(b)).first()[0], 27)


def test_code_quality_modes(code):
    from millrace.operators.code_metrics import code_quality

    strict = {r["id"]: r for r in code_quality(code, "code").collect()}
    compat = {r["id"]: r for r in code_quality(code, "code", compat=True).collect()}
    assert strict[1]["complexity"] is None and not strict[1]["parse_ok"]
    assert (compat[1]["complexity"], compat[1]["readability"]) == (1.0, 1.0)
    lines = len(MIX.split("\n"))
    assert strict[4]["readability"] == pytest.approx(1 / lines) and strict[4]["lines"] == lines and strict[4]["length"] == len(MIX)
    assert compat[4]["complexity"] == 5
