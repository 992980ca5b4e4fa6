"""Jaccard join, lattice hashing, components, cells and top-k against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import blocks, jaccard, lattice, topk
from millrace.llm.components import components


def closure(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sound = [(a, b) for a, b in edges if a is not None]
    want = closure({x for e in sound for x in e}, sound)
    assert got == {i: c for i, c in want.items() if i != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cells_hold_every_pair_once(spark):
    rows = spark.createDataFrame([(g, i) for g, n in ((1, 1), (2, 5), (3, 40), (None, 3)) for i in range(n)], "g int, id long")
    cells = blocks.paired_cells(rows, ["g"], "id", rows=3).collect()
    seen = []
    for key in {(x.g, x.cell_a, x.cell_b) for x in cells}:
        own = [x for x in cells if (x.g, x.cell_a, x.cell_b) == key]
        seen += [(key[0], *sorted((x.id, y.id))) for x in own for y in own if x.id < y.id and (key[1] == key[2] or x.block != y.block)]
    assert sorted(seen) == sorted((g, i, j) for g, n in ((2, 5), (3, 40)) for j in range(n) for i in range(j))


def shingles(text, n):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
    words = [w for w in words.replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("n,num,den,short", [(3, 9, 10, 16), (5, 8, 10, 16), (2, 5, 10, 1), (1, 1, 1, 2)])
def test_jaccard_against_brute_force(spark, monkeypatch, n, num, den, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard._candidates, "__defaults__", (short,))
    monkeypatch.setattr(blocks.paired_cells, "__defaults__", (4,))
    r = random.Random(n)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(12)]
    texts = []
    for _ in range(160):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t) if r.random() < 0.8 else "\n\t".join(t).upper())
    rows = [(i + 10, t, i, "x") for i, t in enumerate(texts)]
    rows += [(1, None, 0, ""), (2, "", 0, ""), (3, " \n ", 0, ""), (None, texts[0], 0, ""), (10, texts[0], 0, ""), (4, "w1 " * 30_000, 0, ""), (5, "É a", 0, ""), (6, "é a", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long, digest string").repartition(5)
    got = sorted((tuple(x) for x in jaccard.similar_groups(docs, n=n, num=num, den=den).collect()), key=str)
    sets = [(i, shingles(t, n)) for i, t, *_ in rows]
    linked = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y)]
    part = closure({i for i, _ in sets if i is not None}, linked)
    assert got == sorted(((i, len(s), part.get(i)) for i, s in sets), key=str)
    assert jaccard.similar_groups(docs.limit(0), n=n).count() == 0


def test_jaccard_repeated_id_joins_its_texts(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "p q r s"), (3, "p q r s"), (9, "a b c d"), (4, "z z z")], "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in jaccard.similar_groups(docs, n=3).collect()}
    assert got == {(7, 3), (3, 3), (9, 3), (4, 4)}


def test_near_copies_cost_as_one_text(spark):
    """Of forty copies with a word of their own each, one prefix goes on, and a set of other size is still found."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(40)] + [(100, " ".join(base[:170])), (101, " ".join(f"v{i}" for i in range(90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = docs.selectExpr("doc_id id", "text __text")
    described = jaccard._described(texts, 3, 8, 10, jaccard._counter_levels(texts, 3)).cache()
    assert described.selectExpr("sum(size(prefix))").first()[0] > 40 * 38
    assert jaccard._heads(described, jaccard._clusters(described)).count() < 5 * 40
    described.unpersist()
    got = {x.doc_id: x.component_id for x in jaccard.similar_groups(docs, n=3, num=8, den=10).collect()}
    assert got == {i: 0 for i, _ in rows} | {101: 101}


@pytest.fixture(scope="module")
def vectors():
    r = np.random.RandomState(4)
    out, i = [], 0
    for label in (0, 1, 2):
        for c in r.randn(25, 16):
            for _ in range(r.randint(1, 12)):
                v = c + r.randn(16) * r.choice([0.0, 0.05, 0.12, 0.2])
                out.append((i, [float(x) for x in v.astype(np.float32)], label))
                i += 1
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15]
    out += [(i + k, v, 1) for k, v in enumerate(odd)] + [(None, out[0][1], 0), (i + 20, out[0][1], None), (i + 21, out[3][1], 0), (i + 22, [3e38] * 16, 0)]
    return out


def test_lattice_against_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks.paired_cells, "__defaults__", (4,))
    df = spark.createDataFrame([(*v, 0, "x") for v in vectors], "vec_id long, embedding array<float>, label int, links long, digest string").repartition(4)
    got = {x.vec_id: x for x in lattice.similar_vectors(df).collect()}
    assert len(got) == len(vectors)
    sound = [(i, np.array(v, dtype=np.float64), c) for i, v, c in vectors if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a, b) for k, (a, x, c) in enumerate(sound) for b, y, d in sound[:k] if c == d and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    want = closure({v[0] for v in vectors if v[0] is not None}, pairs)
    links = {i: sum(i in p for p in pairs) for i in want}
    assert all(got[i].n_links <= links[i] for i in want)
    assert sum(got[i].n_links for i in want) >= 0.99 * sum(links.values())
    assert sum(got[i].component_id == want[i] for i in want) >= 0.99 * len(want)
    assert all(x.kept == (x.vec_id == x.component_id) for i, x in got.items() if i is not None)
    assert got[None].n_links == 0 and got[None].component_id is None
    assert lattice.similar_vectors(df.limit(0)).count() == 0


def test_lattice_points():
    r = np.random.RandomState(0)
    x = r.randn(300, 8) * 1.5
    p = lattice.decode(x)
    assert len(lattice.NEAR) == 240 and np.allclose((lattice.NEAR**2).sum(1), 2)
    assert ((x - p) ** 2).sum(1).max() <= 1 + 1e-9
    assert all((((x - p) ** 2).sum(1) <= ((x - p - v) ** 2).sum(1) + 1e-9).all() for v in lattice.NEAR)


def brute_top(rows, k):
    sound = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for q, v in sound.items():
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in sound.items() if i != q)[:k]
            yield from ((q, n, i, -s) for n, (s, i) in enumerate(best, 1))


@pytest.mark.parametrize("k,tile,shard,scale", [(20, 1024, 4096, 1.0), (3, 2, 7, 1.0), (500, 3, 20, 1.0), (5, 4, 30, 1e6)])
def test_top_k_against_brute_force(spark, vectors, k, tile, shard, scale):
    usable = [(i, v and [x if x is None else float(np.float32(x * scale)) for x in v], c) for i, v, c in vectors if not v or max(x or 0 for x in v) < 1e3]
    usable += [(1000 + i, [0.5] * 16, 1) for i in range(40)]
    df = spark.createDataFrame([(*v, 1) for v in usable], "vec_id long, embedding array<float>, label int, score long").repartition(3)
    rows = df.select(F.col("vec_id").alias("id"), topk.grid(F.col("embedding")).alias("vec"))
    got = topk.top_k(rows.where("id % 20 = 0"), rows, k, tile, shard)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(usable, k))
    assert topk.top_k(rows.limit(0), rows, k).count() == 0 and topk.top_k(rows.where("id % 20 = 0"), rows.limit(0), k).count() == 0


def test_top_k_of_numbers_beyond_doubles():
    q = np.array([[2**31 - 1, 1]], dtype=np.int64)
    items = np.array([[2**31 - 1, 0], [2**31 - 1, 1], [2**31 - 1, 2]], dtype=np.int64)
    _, score, item = topk.best_of_tile(q, np.array([99]), items, np.array([1, 2, 3]), 2)
    assert sorted(zip(score.tolist(), item.tolist(), strict=True)) == [((2**31 - 1) ** 2 + 1, 2), ((2**31 - 1) ** 2 + 2, 3)]


def test_vectors_of_other_length_share_a_lattice(spark):
    """A vector and its copy with a small tail meet, though they come in batches of their own."""
    r = np.random.RandomState(4)
    rows = []
    for i in range(20):
        v = r.standard_normal(64)
        rows += [(2 * i, [float(x) for x in v], 1), (2 * i + 1, [float(x) for x in v] + [0.001] * (1 + i), 1)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1")
    try:
        got = {x.vec_id: (x.n_links, x.component_id) for x in lattice.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    finally:
        spark.conf.set(batch, before)
    assert got == {i: (1, i - i % 2) for i in range(40)}


def test_repeated_query_ids_take_the_smallest_vector(spark):
    df = spark.createDataFrame([(1, [2, 0]), (1, [0, 3]), (1, [2, 0]), (2, [5, 1]), (3, [1, 5])], "id long, vec array<long>")
    for n in (1, 4):
        got = topk.top_k(df.where("id = 1").repartition(n), df, 2).collect()
        assert sorted(map(tuple, got)) == [(1, 1, 3, 15), (1, 2, 2, 3)]
