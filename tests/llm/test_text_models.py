"""Toxicity and quality: learned on one part, right on another; odd rows; sharded and fallback ways."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "re", "tu", "so", "ne") for b in ("ra", "li", "mo", "te", "su", "na")]
BAD = ["vilezz", "grimzz", "foulzz"]
EDGE = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "ka " * 20_000), (9005, "x"), (None, "kara lo")]


def text(r, bad=False, junk=False):
    w = [r.choice(WORDS) for _ in range(r.randint(20, 60))]
    if bad:
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(BAD))
    if junk:
        w = [r.choice(w[:3])] * len(w) if r.random() < 0.5 else [x.upper() + "!!" for x in w]
    return " ".join(w) + "."


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        bad, junk = r.random() < 0.3, r.random() < 0.2
        rows.append((i, text(r, bad, junk), "extra", 0.5, i))
        labels.append((i, int(not junk), int(bad)))
    rows += [(i, t, "extra", 0.5, 0) for i, t in EDGE] + rows[:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label double, __text long").repartition(3)
    return docs, spark.createDataFrame([*labels, labels[0], (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int"), {a: (b, c) for a, b, c in labels}, len(rows)


@pytest.mark.parametrize("shards,rounds", [(1, 1), (3, 3)])
def test_toxicity_on_held_out_rows(spark, data, shards, rounds):
    docs, labels, truth, n = data
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0 or doc_id is null"), l1=2.0, shards=shards, rounds=rounds)
    got = toxicity.score(docs, model).select("doc_id", "score", "label", "__text").collect()
    assert len(got) == n and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.doc_id in truth and x.doc_id % 3 == 0]
    assert sum((x.score >= 0.3) == bool(truth[x.doc_id][1]) for x in held) > 0.9 * len(held)
    assert len(model.keys) < 1_000


def test_toxicity_bound_and_no_labels(spark, data):
    docs, labels, _, n = data
    sample = toxicity._sample(docs, labels, "doc_id", "text", "toxic", 200)
    assert 100 < sample.count() < 300
    empty = toxicity.fit(docs, labels.limit(0))
    assert {x.score for x in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_toxicity_learns_from_all_of_20000_labels(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'kara lo' as text")
    labels = docs.selectExpr("doc_id", "0 as toxic")
    assert toxicity._sample(docs, labels, "doc_id", "text", "toxic", toxicity.MAX_ROWS).count() == 20_000


def test_quality_on_held_out_rows(spark, data):
    docs, labels, truth, n = data
    rows, model = quality.train(quality.described(docs, keep=["doc_id"]), labels.where("doc_id % 3 <> 0 or doc_id is null"))
    got = quality.scored(rows, model).collect()
    assert len(got) == n and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.doc_id in truth and x.doc_id % 3 == 0]
    good, junk = ([x.score for x in held if truth[x.doc_id][0] == y] for y in (1, 0))
    assert sum(a > b for a in good for b in junk) > 0.95 * len(good) * len(junk)
    assert sum((x.score >= 0.5) == bool(truth[x.doc_id][0]) for x in held) > 0.8 * len(held)
    again = {(x.doc_id, round(x.score, 9)) for x in quality.score(docs, model).select("doc_id", "score").collect()}
    assert again == {(x.doc_id, round(x.score, 9)) for x in got}


def test_quality_prior_without_negatives_and_without_positives(spark, data):
    docs, labels, truth, _ = data
    described = quality.described(docs, keep=["doc_id"])
    _, model = quality.train(described, labels.where("quality = 1 and doc_id % 2 = 0"))
    assert 0.5 < model.prior <= 0.95
    rows, model = quality.train(described, labels.limit(0))
    assert {x.score for x in quality.scored(rows, model).collect()} == {0.5}
    rows, model = quality.train(quality.described(docs.limit(0), keep=["doc_id"]), labels)
    assert quality.scored(rows, model).count() == 0


def test_nothing_but_the_text_is_read(data):
    docs, labels, _, _ = data
    plan = quality.described(docs, keep=["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "score#" not in plan.split("MapInArrow")[1].split("\n")[1]


def test_training_against_plain_rows(spark):
    """The weights of one shard against a loop over texts with sets of words, and the same for any partitioning."""
    import math

    import xxhash

    r = random.Random(9)
    names = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.sample(names, r.randint(1, 6)) + (["bad"] if i % 4 == 0 else [])), int(i % 4 == 0 or r.random() < 0.05)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 0), (901, None)], "doc_id long, toxic int")
    models = [toxicity.fit(docs.repartition(k), labels.repartition(k), min_rows=3, l1=0.5, epochs=2) for k in (1, 5)]
    assert (models[0].keys == models[1].keys).all() and np.allclose(models[0].weights, models[1].weights)
    own = {}
    for i, t, y in [*rows, (900, "", 0)]:
        w = t.split()
        grams = {(x,) for x in w} | {(d, x, y2) for d in (1, 2, 3) for x, y2 in zip(w, w[d:], strict=False)}
        own[i] = (grams, y)
    n_rows = {}
    for grams, _ in own.values():
        for g in grams:
            n_rows[g] = n_rows.get(g, 0) + 1
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0)) <= 0.5 else (math.copysign(0.5, z[k]) - z[k]) / ((1 + math.sqrt(n[k])) / 0.6 + 0.1)
    for _ in range(2):
        for i in sorted(own, key=lambda i: xxhash.xxh3_64_intdigest(str(i))):
            keys = [g for g in own[i][0] if n_rows[g] >= 3] + ["bias"]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - own[i][1]
            for k in keys:
                z[k] = z.get(k, 0) + g - (math.sqrt(n.get(k, 0) + g * g) - math.sqrt(n.get(k, 0))) / 0.6 * w[k]
                n[k] = n.get(k, 0) + g * g
    want = sorted(v for k in z if k != "bias" and (v := weight(k)))
    assert np.allclose(sorted(models[0].weights), want) and abs(models[0].bias - weight("bias")) < 1e-9
    score = {x.doc_id: x.score for x in toxicity.score(docs, models[0]).collect()}
    assert all(abs(score[i] - 1 / (1 + math.exp(-sum(weight(k) for k in own[i][0] if n_rows[k] >= 3 and k in z) - weight("bias")))) < 1e-9 for i in own)
