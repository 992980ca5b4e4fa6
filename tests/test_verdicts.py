import random
import time

from math import comb

import pytest
from pyspark.sql import functions as F

from millrace.operators import layout, verdicts as vd
from millrace.functions import privacy
from millrace.operators import overlap, rules
from millrace.operators.ordered import top_per_key


def test_problem_verdicts(spark):
    df = spark.createDataFrame([("none", None), ("pass", True), ("mixed", True), ("mixed", False)], "p string, passed boolean")
    got = {r["p"]: (r["passed"], r["passed_strict"], r["n_tests"]) for r in vd.problem_verdicts(df, ["p"]).collect()}
    assert got == {"none": (True, False, 0), "pass": (True, True, 1), "mixed": (False, False, 2)}


def test_all_passed_of_empty_array(spark):
    df = spark.createDataFrame([([],), ([True],), ([True, False],)], "t array<boolean>")
    assert [r[0] for r in df.select(vd.all_passed(F.col("t"))).collect()] == [True, True, False]


@pytest.mark.parametrize("n,c,k", [(10, 0, 1), (10, 3, 5), (10, 10, 10), (26, 7, 10), (5, 1, 5), (3, 1, 5), (100, 2, 10)])
def test_pass_at_k(spark, n, c, k):
    got = spark.range(1).select(vd.pass_at_k(F.lit(n), F.lit(c), k)).first()[0]
    if n < k:
        assert got is None
    else:
        assert got == pytest.approx(1 - comb(n - c, k) / comb(n, k))


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_leaderboard_ties_go_by_name(spark, limit):
    df = spark.createDataFrame([("m", "b", 0.5), ("m", "a", 0.5), ("m", "c", 0.9), ("n", "a", 0.1)], "metric string, model string, value double")
    got = {(r["metric"], r["model"]): r["position"] for r in vd.leaderboard(df, limit=limit).collect()}
    assert got == {("m", "c"): 1, ("m", "a"): 2, ("m", "b"): 3, ("n", "a"): 1}


def test_report_text(spark):
    df = spark.createDataFrame([("b", "x", 0.25, 1, 4), ("a", "x", 0.5, 2, 4)], "model string, benchmark string, pass_at_1 double, solved_problems long, total_problems long")
    lines = vd.report_lines(df, "T", "now").orderBy("section", "group", "line_no").collect()
    text = "\n".join(r["line"] for r in lines)
    assert text == (
        "# T\n\nGenerated: now\n\n## Summary\n\n### x_pass_at_1\n1. a: 0.500\n2. b: 0.250\n\n## Details\n"
        "\n### a\n\n#### X\n- Pass@1: 0.500\n- Problems: 4\n- Solved: 2\n\n### b\n\n#### X\n- Pass@1: 0.250\n- Problems: 4\n- Solved: 1"
    )


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_turn_pairs(spark, limit):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "user", "s"), (1, 4, "assistant", "t"), (2, 0, "assistant", "z"), (2, 1, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in layout.turn_pairs(df, limit=limit).collect()}
    assert got == {(1, 0, "q", "a"), (1, 3, "s", "t")}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_bleu_and_rouge(spark):
    texts = [("the cat sat on the mat", "the cat is on the mat"), ("a b c d e", "a b c d e"), ("A b", "a B c d"), ("the the the", "the"), ("", "x"), (None, "x"), ("x", None), ("b a c a", "a b a c x a")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, c string, r string")
    bleu = {x["id"]: x["bleu"] for x in overlap.bleu(df, ["id"], "c", "r").collect()}
    assert bleu[1] == pytest.approx(1) and all(bleu[i] == 0 for i in (0, 2, 3, 4, 5, 6, 7))
    two = {x["id"]: x["bleu"] for x in overlap.bleu(df, ["id"], "c", "r", 2).collect()}
    assert two[0] == pytest.approx((5 / 6 * 3 / 5) ** 0.5) and two[2] == pytest.approx(2.718281828459045 ** (1 - 4 / 2))
    rouge = {x["id"]: (x["rouge_1"], x["rouge_2"]) for x in overlap.rouge(df, ["id"], "c", "r").collect()}
    assert rouge[0] == (pytest.approx(10 / 12), pytest.approx(6 / 10)) and rouge[3] == (0.5, 0.0) and rouge[5] == (0.0, 0.0)
    for x in df.select("id", overlap.rouge_l(F.col("c"), F.col("r")).alias("v")).collect():
        c, r = ((t or "").lower().split() for t in texts[x["id"]])
        n = lcs(c, r)
        assert x["v"] == pytest.approx(2 * n / (len(c) + len(r)) if n else 0)


def test_score_threshold_masks_and_pseudonyms(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "id long, t string")
    known = spark.createDataFrame([(1, 0.4), (2, 0.5), (None, 0.9)], "id long, s double")
    keep = lambda u: sorted(str(r["id"]) for r in rules.score_at_least(df, known, "id", "s", 0.5, u).collect())
    assert keep(False) == ["2", "None"] and keep(True) == ["2", "3", "None"]
    twice = known.union(spark.createDataFrame([(1, 0.6), (2, 0.1), (2, 0.5), (3, None)], known.schema))
    again = rules.score_at_least(df, twice, "id", "s", 0.5)
    assert sorted(str(r["id"]) for r in again.collect()) == ["1", "2", "None"]
    texts = ["write to a.b+c@mail.example.org.", "from 10.0.0.255 and 1234 5678-90123456", "key " + "0a" * 20, None, "plain 1.2.3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(privacy.mask(F.col("t"))).collect()]
    assert got == ["write to [EMAIL].", "from [ADDRESS] and [CARD]", "key [SECRET]", None, "plain 1.2.3"]
    names = [r[0] for r in spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string").select(privacy.pseudonym(F.col("v"), "s")).collect()]
    assert names[0] == names[1] != names[2] and len(names[0]) == 16 and names[3] is None


def test_top_per_key(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 5), (None, 4), ("b", 9)], "k string, v int")
    got = sorted((str(r["k"]), r["v"]) for r in top_per_key(df, ["k"], [F.col("v")], 2).collect())
    assert got == [("None", 4), ("None", 5), ("a", 1), ("a", 2), ("b", 9)]


def test_longest_common_subsequence_by_bits():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(40))] for _ in range(2))
        assert overlap.shared_in_order(a, b, rng.choice([1, 3, 8, 64])) == lcs(a, b)
    assert overlap.shared_in_order([None, "a"], [None, "a"]) == 1
    a, b = ([rng.randrange(500) for _ in range(4000)] for _ in range(2))
    begin = time.perf_counter()
    n = overlap.shared_in_order(a, b)
    assert time.perf_counter() - begin < 1 and n == overlap.shared_in_order(b, a, 1000)


def test_corpus_bleu(spark):
    rows = [
        (1, "x", "the the the cat", ["the cat", "the the dog"]),
        (2, "x", "a b c d e", ["a b c d", "z", "a b c d e f"]),
        (3, None, "a b", None),
        (4, None, None, ["a", None]),
        (5, "y", "a b", []),
    ]
    df = spark.createDataFrame(rows, "id int, g string, c string, rs array<string>")
    got = {r["g"]: tuple(r)[1:] for r in overlap.corpus_bleu(df, ["id"], ["g"], "c", "rs", 2).collect()}
    # words: 3 of 4 and 5 of 5 match; pairs: 2 of 3 and 4 of 4; lengths 9 against 3 + 4
    assert got["x"] == (9, 7, pytest.approx((8 / 9 * 6 / 7) ** 0.5))
    assert got[None] == (0, 0, 0.0) and set(got) == {"x", None}
    one = overlap.corpus_bleu(df.where("id = 2").withColumn("rs", F.array(F.lit("a b c d e f"))), ["id"], [], "c", "rs").first()
    assert one["bleu"] == pytest.approx(2.718281828459045 ** (1 - 6 / 5))


def test_corpus_bleu_leaves_out_reference_grams_its_candidate_lacks(spark):
    texts = spark.createDataFrame([(1, ["a", "b"], [["a", "b", "x", "y", "a"], ["z"]])], "id long, __c array<string>, __r array<array<string>>")
    got = sorted((r["n"], r["side"], r["gram"]) for r in overlap.held_grams(texts, ["id"], 2).collect())
    assert got == [(1, 0, "a"), (1, 0, "b"), (1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (2, 0, "a b"), (2, 1, "a b")]


def test_corpus_bleu_counts_within_rows_and_pools_repeated_keys(spark):
    import math
    from collections import Counter

    rng = random.Random(7)
    text = lambda most: " ".join(rng.choice("abcd") for _ in range(rng.randrange(most)))
    rows = [(None if i % 9 == 0 else i % 50, "xy"[i % 50 % 2], text(30), [text(20) for _ in range(rng.randrange(1, 4))]) for i in range(80)]
    rows += [(200, "x", "a b c d " * 5000, ["b c d a " * 4000, "d"])]  # in time that grows with the words
    df = spark.createDataFrame(rows, "id int, g string, c string, rs array<string>").repartition(3)
    begin = time.perf_counter()
    got = {r["g"]: tuple(r)[1:] for r in overlap.corpus_bleu(df, ["id"], ["g"], "c", "rs").collect()}
    assert time.perf_counter() - begin < 60
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for g in "xy":
        own = [(i, c.split(), [r.split() for r in rs]) for i, k, c, rs in rows if k == g]
        total, nearest = sum(len(c) for _, c, _ in own), sum(min((abs(len(r) - len(c)), len(r)) for r in rs)[1] for _, c, rs in own)
        log = 0.0
        for n in range(1, 5):
            sides = {}
            for i, c, rs in own:
                of = sides.setdefault(i, [Counter()])
                of[0] += grams(c, n)
                for k, r in enumerate(rs, 1):
                    of += [Counter()] * (k + 1 - len(of))
                    of[k] = of[k] + Counter({x: t for x, t in grams(r, n).items() if x in grams(c, n)})
            matched = sum(min(t, max([s[x] for s in of[1:]])) for of in sides.values() for x, t in of[0].items())
            log += math.log(matched / sum(sum(of[0].values()) for of in sides.values())) / 4
        assert got[g] == (total, nearest, pytest.approx((1 if total > nearest else math.exp(1 - nearest / total)) * math.exp(log)))


def test_gram_matches_count_totals_and_shared_grams_only(spark):
    pairs = spark.createDataFrame([(1, "a b a c", "a a d"), (None, "x y", None)], "k long, a string, b string")
    got = sorted((tuple(r) for r in overlap.gram_matches(pairs, ["k"], "a", "b", 2).collect()), key=str)
    assert got == sorted([(1, 1, 2, 4, 3), (1, 2, 0, 3, 2), (None, 1, 0, 2, 0), (None, 2, 0, 1, 0)], key=str)
    plan = overlap.gram_matches(pairs, ["k"], "a", "b", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan
