"""Near-duplicate vectors by lattice hashing with E8, verified by cosine.

1. Vectors with equal label and equal components are one class; one of each goes on.
2. Each of several tables projects the unit vector to eight dimensions at random, shifts and
   scales it and decodes it to the nearest point of the lattice E8. That point is the vector's
   home; the nearest few of its 240 neighbours are probed as well.
3. Classes meet under a lattice point if one of them is at home there. Points that only one
   class touches are dropped before the vectors are fetched, and crowded points are cut into
   cells of bounded size that hold each pair once (`blocks.paired_cells`).
4. In a cell the cosines are a matrix product. A pair that would also meet earlier (in an
   earlier table, or in the same one by the smaller row's probe) is counted there only, which
   a cell can tell from the vectors themselves. So a cell gives, for each class, a sum of
   partners and one link into its local component; pairs are never written.
5. Sums are added up, components are those of the links.

The search may miss pairs (recall is measured in the tests and stated in the README); it
never links a pair below the threshold.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import paired_cells
from millrace.llm.common import mixed
from millrace.llm.components import components
from millrace.session import cut

TABLES, PROBES, STEP, SEED = 3, 4, 0.5, 8
"""Tables, probed neighbours per table, size of the lattice against the unit vector, seed of the projections."""


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEAR = neighbours()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum (the lattice D8)."""
    p = np.round(x)
    odd = np.flatnonzero(p.sum(1) % 2 != 0)
    miss = x[odd] - p[odd]
    worst = np.abs(miss).argmax(1)
    p[odd, worst] += np.where(miss[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return p


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 = D8 and D8 + 1/2 for each row."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def _keys(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(points.shape[:-1], table + 1, dtype=np.uint64)
    for i in range(8):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.round(2 * points[..., i]).astype(np.int64).astype(np.uint64))
    return h.astype(np.int64)


def homes_and_probes(
    unit: np.ndarray, table: int, probes: int = PROBES, step: float = STEP, seed: int = SEED, length: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home (n) and probed points (n, probes), as 64-bit digests.

    `length`: of the longest vector of the table, which all rows are projected as; by default that of these rows.
    """
    length = length or unit.shape[1]
    draw = np.random.RandomState(seed + 1000 * table)
    basis, _ = np.linalg.qr(draw.standard_normal((max(length, 8), 8)))
    x = unit @ basis[: unit.shape[1]] * (np.sqrt(length / 8) / step) + draw.uniform(-1, 1, 8)
    home = decode(x)
    nearest = np.argsort(-((x - home) @ NEAR.T), axis=1, kind="stable")[:, :probes]
    return _keys(home, table), _keys(home[:, None, :] + NEAR[nearest], table)


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one; a shorter one is filled up with zeros."""
    rows = [np.asarray(v.values, dtype=np.float64) for v in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v / np.abs(v).max()
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _local_roots(linked: np.ndarray) -> np.ndarray:
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def matched(unit: np.ndarray, weight: np.ndarray, at_home: np.ndarray, block: np.ndarray, rank: np.ndarray, table: int, threshold: float,
            probes: int = PROBES, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the weights of each row's partners that are counted here, local root) in one cell."""
    close = np.triu(unit @ unit.T >= threshold, 1)
    close &= at_home[:, None] | at_home[None, :]
    if len(np.unique(block)) > 1:
        close &= block[:, None] != block[None, :]
    i, j = np.nonzero(close)
    swap = rank[i] > rank[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    first = np.ones(len(i), dtype=bool)
    if len(i):
        for t in range(table + 1):
            home, probe = homes_and_probes(unit, t, probes, length=length)
            same = home[i] == home[j]
            small_finds = (probe[i] == home[j][:, None]).any(1)
            if t < table:
                first &= ~(same | small_finds | (probe[j] == home[i][:, None]).any(1))
            else:
                first &= ~(small_finds & at_home[i] & ~at_home[j])  # it is counted where the smaller row probes
    i, j = i[first], j[first]
    links = np.bincount(i, weights=weight[j], minlength=len(unit)) + np.bincount(j, weights=weight[i], minlength=len(unit))
    linked = np.zeros((len(unit), len(unit)), dtype=bool)
    linked[i, j] = linked[j, i] = True
    return links.astype(np.int64), _local_roots(linked)


def similar_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Only rows of the same label, not null, link. `n_links` counts the other rows that are
    linked directly, copies included; `component_id` is the smallest id reachable, itself
    included. A row links with nothing if its id or vector is null, its vector is empty or
    zero, or a component is null or not finite. Rows that repeat an id are rows of their own.
    Other columns aren't read. An empty table gives no rows.
    """
    v, own = F.col("vec"), F.col("id")
    sound = v.isNotNull() & own.isNotNull() & F.col("label").isNotNull()
    sound &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = df.select(df[vec_id].alias("id"), df[vector].alias("vec"), df[label].alias("label"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    digest = F.struct(F.xxhash64("label", "vec").alias("x"), F.xxhash64(F.lit(1), "vec", "label").alias("y"))
    marked = rows.withColumn("digest", digest)
    classes = cut(
        marked.where("sound").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec"), F.any_value("label").alias("label"))
    )
    kind = dict(classes.dtypes)["rep"]
    length = classes.agg(F.max(F.size("vec")).alias("n")).first()["n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(batch.column(2))
            for t in range(tables):
                home, probe = homes_and_probes(unit, t, probes, length=length)
                every = np.concatenate([home, probe.ravel()])
                at = np.concatenate([np.arange(len(unit)), np.repeat(np.arange(len(unit)), probes)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(pa.array(at)) for i in (0, 1)]
                    + [pa.array(np.full(len(every), t, dtype=np.int32)), pa.array(every), pa.array(np.arange(len(every)) < len(unit))],
                    ["rep", "label", "tab", "point", "home"],
                )

    label_kind = dict(classes.dtypes)["label"]
    touched = classes.select("rep", "label", "vec").mapInArrow(place, f"rep {kind}, label {label_kind}, tab int, point long, home boolean")
    occupied = touched.where("home").groupBy("label", "tab", "point").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    touched = touched.join(occupied, ["label", "tab", "point"]).where("home or rep <> least or rep <> most").drop("least", "most")
    cells = paired_cells(touched, ["label", "tab", "point"], "rep")
    filled = cells.join(classes.select("rep", F.col("n").alias("weight"), "vec", F.col("digest.x").alias("rank")), "rep")

    def verify(table: pa.Table) -> pa.Table:
        ids = table["rep"].combine_chunks()
        arrays = (table[c].to_numpy() for c in ("weight", "home", "block", "rank"))
        links, root = matched(_units(table["vec"].combine_chunks()), *arrays, table["tab"][0].as_py(), threshold, probes, length)
        some = np.flatnonzero(links)
        return pa.table({"a": ids.take(pa.array(some)), "b": ids.take(pa.array(root[some])), "links": pa.array(links[some])})

    found = cut(filled.groupBy("label", "tab", "point", "cell_a", "cell_b").applyInArrow(verify, f"a {kind}, b {kind}, links long"))
    sums = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    near = components(found.select("a", "b")).withColumnRenamed("id", "rep")
    per_class = classes.select("digest", "rep", "n").join(sums, "rep", "left").join(near, "rep", "left")
    per_class = per_class.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = marked.where("sound").select("id", "digest").join(per_class, "digest").select("id", "n_links", "component_id")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = joined.union(alone)
    return result.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
