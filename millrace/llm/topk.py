"""Exact top-k by inner product: tiled matrix products, selection per tile, merging of lists.

Queries are dealt into tiles and candidates into shards by the digest of their ids, of a size
that does not grow with the data. Each (tile, shard) is one task group: both sides are brought
together by a shuffle, multiplied as matrices, and only each query's k best of that shard
leave it. The lists are then merged as a tree, `FAN` at a time. Neither side is broadcast or
brought to the driver; a query meets every candidate in blocks, never as joined rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_ROWS, SHARD_ROWS, FAN = 1024, 4096, 16
_NONE = np.iinfo(np.int64).min


def grid(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as long; null for a vector that is null or holds null or non-finite components."""
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] + [np.zeros(0, dtype=np.int64)]).astype(np.int64)] = np.asarray(column.flatten())
    return out


def best_of_tile(queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, item id) of each query's k best items, ties to the smaller id; `item_ids` ascending."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(items).max(initial=0)) * max(queries.shape[1], 1)
    if reach < 2**53:  # doubles hold every sum exactly
        scores = (queries.astype(np.float64) @ items.astype(np.float64).T).astype(np.int64)
    else:
        scores = queries @ items.T
    scores[query_ids[:, None] == item_ids[None, :]] = _NONE
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        above, level = scores > least, scores == least
        chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
    else:
        chosen = np.ones(scores.shape, dtype=bool)
    row, column = np.nonzero(chosen & (scores != _NONE))
    return row, scores[row, column], item_ids[column]


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(queries: DataFrame, items: DataFrame, k: int, tile_rows: int = TILE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id, vec) tables of whole-number vectors.

    A candidate with the query's own id is left out. Rows whose id or vector is null take no
    part. A shorter vector counts as filled up with zeros. Scores must fit 64 bits. Repeated
    query rows give one list, that of the smallest vector if one id has several; repeated candidate rows are candidates of their own. Fewer than
    k candidates give all there are; an empty side gives no rows.
    """
    queries = queries.where("id is not null and vec is not null").groupBy(F.col("id").alias("qid")).agg(F.min("vec").alias("qvec"))
    items = items.where("id is not null and vec is not null").select("id", "vec")
    tiles, shards = (max(1, -(-side.count() // rows)) for side, rows in ((queries, tile_rows), (items, shard_rows)))
    left = queries.withColumn("tile", F.pmod(F.xxhash64("qid"), F.lit(tiles))).withColumn("shard", _each(shards))
    right = items.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("tile", _each(tiles))
    kind = dict(items.dtypes)["id"]

    def best(key, one: pa.Table, other: pa.Table) -> pa.Table:
        other = other.sort_by("id")
        width = max((int(np.diff(np.asarray(t[c].combine_chunks().offsets)).max(initial=0)) for t, c in ((one, "qvec"), (other, "vec")) if len(t)), default=0)
        row, score, item = (
            best_of_tile(_matrix(one["qvec"], width), one["qid"].to_numpy(), _matrix(other["vec"], width), other["id"].to_numpy(), k)
            if len(one) and len(other)
            else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        )
        ids = one["qid"].combine_chunks() if len(one) else pa.array([], type=one.schema.field("qid").type)
        return pa.table({"qid": ids.take(pa.array(row)), "part": pa.array(np.full(len(row), key[1].as_py())), "less": pa.array(-score), "id": pa.array(item)})

    lists = left.groupBy("tile", "shard").cogroup(right.groupBy("tile", "shard")).applyInArrow(best, f"qid {kind}, part long, less long, id {kind}")
    best_first = lambda all_of: F.slice(F.array_sort(all_of), 1, k)
    merged = lists.groupBy("qid", F.floor(F.col("part") / FAN).alias("part")).agg(best_first(F.collect_list(F.struct("less", "id"))).alias("best"))
    parts = -(-shards // FAN)
    while parts > 1:
        merged = merged.groupBy("qid", F.floor(F.col("part") / FAN).alias("part")).agg(best_first(F.flatten(F.collect_list("best"))).alias("best"))
        parts = -(-parts // FAN)
    ranked = merged.select("qid", F.posexplode("best").alias("at", "hit"))
    return ranked.select(F.col("qid").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
