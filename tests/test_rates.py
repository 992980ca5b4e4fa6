import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.rates import rate_audit

BASE = dt.datetime(2024, 1, 1)


def frame(spark, seconds, key="a"):
    data = [(i, key if isinstance(key, str) else key(i), BASE + dt.timedelta(seconds=s), 10) for i, s in enumerate(seconds)]
    return spark.createDataFrame(data, "id long, key string, ts timestamp, tok long")


def test_window_is_open_at_its_old_end(spark):
    out = rate_audit(frame(spark, [0, 30, 59.999999, 60]), ["key"], "ts", "id", F.col("tok"), 60, 2, 10**9)
    got = {r["id"]: (r["in_window"], r["rpm_hit"], r["wait_s"]) for r in out.collect()}
    assert got[0] == (0, False, None)
    assert got[1] == (1, False, None)
    assert got[2][:2] == (2, True) and got[2][2] == pytest.approx(0.000001)
    assert got[3][:2] == (2, True) and got[3][2] == pytest.approx(30)


def test_estimate_alone_above_the_limit(spark):
    out = rate_audit(frame(spark, [0, 500]), ["key"], "ts", "id", F.col("tok"), 60, 2, 5).collect()
    assert all(r["tpm_hit"] and r["no_history"] and r["wait_s"] is None for r in out)


def brute(events, span, rpm, tpm):
    want = {}
    for i, key, t, tok in events:
        inside = [e for e in events if e[1] == key and t - span < e[2] < t]
        n, s = len(inside), sum(e[3] for e in inside)
        hit, over = n >= rpm, s + tok > tpm
        oldest = min((e[2] for e in inside), default=None)
        wait = (span - (t - oldest)) if (hit or over) and oldest is not None else None
        want[i] = (n, s, hit, over, None if wait is None else round(wait, 6))
    return want


@pytest.mark.parametrize("limit", [1_000_000, 11])
@pytest.mark.parametrize("keys", [["key"], []])
def test_against_brute_force(spark, keys, limit):
    rng = random.Random(3)
    events = []
    for i in range(300):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(9)}"
        events.append((i, key, rng.randrange(600), rng.randrange(1, 40)))
    df = spark.createDataFrame([(i, k, BASE + dt.timedelta(seconds=t), tok) for i, k, t, tok in events], "id long, key string, ts timestamp, tok long")
    if not keys:
        events = [(i, "", t, tok) for i, _, t, tok in events]
    out = rate_audit(df, keys, "ts", "id", F.col("tok"), 60, 3, 90, limit=limit).collect()
    got = {r["id"]: (r["in_window"], r["tokens_in_window"], r["rpm_hit"], r["tpm_hit"], None if r["wait_s"] is None else round(r["wait_s"], 6)) for r in out}
    assert got == brute(events, 60, 3, 90)
