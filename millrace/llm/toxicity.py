"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct 40-bit hashes of a text's words, word pairs and pairs of words
with one or two words between them. Learning (McMahan et al., 2013): every coordinate has
its own rate, and L1 keeps the weights sparse, so the model that goes to the executors is
two short arrays. It is fitted on at most `max_rows` labelled rows, taken by a digest of
their ids, and at most MAX_CHARACTERS of them; coordinates that fewer than `min_rows` of them hold are left out, which is the
usual inclusion rule and bounds the model (words are counted first, as a pair can't be more
frequent than its words). The sample may be dealt into `shards`; each round
trains every shard from the shared state in a task of its own and the states are averaged.
One shard learns best and, as the sample is bounded, is the default. All documents are
scored, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import beside_text, gram_hashes, one_label, text_slices, word_hashes, words_of
from millrace.session import cut

MAX_ROWS = 24_000
"""Labelled rows to learn from, at most."""
MAX_CHARACTERS = 128 << 20
"""Characters of them, at most, on the whole; their known features take no more than four times as many bytes while learning."""
MAX_LEARNED = 2 << 20
"""A longer text is not learned from."""
SLICE_BYTES = 512 << 10
"""Text whose features a task holds at a time; they take some forty times as much."""
EDGES = ".,;:!?\"'()[]{}<>*_#%&$|-~`^+=/\\"
"""Characters that are stripped from the ends of words."""


def _among(known: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Whether each feature is one of the sorted known ones."""
    if not len(known):
        return np.zeros(len(features), dtype=bool)
    return known[np.minimum(np.searchsorted(known, features), len(known) - 1)] == features


def _places(known: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Where the features that are known stand among the known ones."""
    return np.searchsorted(known, features[_among(known, features)])


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, features: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sum of the weights of each text's distinct features, plus the bias."""
        hit = np.flatnonzero(_among(self.keys, features))
        doc, at = np.searchsorted(ends[1:], hit, side="right"), np.searchsorted(self.keys, features[hit])
        found = np.unique(doc * max(len(self.keys), 1) + at)
        doc, at = np.divmod(found, max(len(self.keys), 1))
        return self.bias + np.bincount(doc, weights=self.weights[at], minlength=len(ends) - 1)


def _narrow(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(24)).astype(np.int64)


def features_of(texts: pa.Array, gaps: tuple = ((), (1,), (2,), (3,)), within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts, one text after another, and where each text's begin and end.

    `gaps`: () stands for words, (1,) for pairs, (2,) for pairs with a word between. `within`:
    sorted word features; pairs with other words are left out.
    """
    words = words_of(pc.utf8_split_whitespace(pc.utf8_lower(texts)))
    bare = pc.utf8_trim(words.distinct, characters=EDGES)
    h = word_hashes(bare)[words.codes]
    doc = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    known = _among(within, _narrow(gram_hashes(h, ()))) if within is not None else np.ones(len(h), dtype=bool)
    grams, owners = [], []
    for gap in gaps:
        reach = max(gap, default=0)
        g = gram_hashes(h, gap)
        inside = (doc[: len(g)] == doc[reach:]) & known[: len(g)] & known[reach:] if reach else known
        grams.append(g[inside])
        owners.append(doc[: len(g)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return _narrow(np.concatenate(grams)[order]), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words.offsets) - 1))])


def _sample(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(id, label, text) of at most about `max_rows` labelled documents and MAX_CHARACTERS."""
    known = one_label(labels, doc_id, label)
    total = known.count()
    draw = F.pmod(F.xxhash64("__id"), F.lit(1_000_000))
    if total > max_rows:
        known = known.where(draw < int(1_000_000 * max_rows / total))
    texts = df.select(df[doc_id].alias("__id"), df[text].alias("__text")).where(F.char_length(F.coalesce("__text", F.lit(""))) <= MAX_LEARNED)
    sample = texts.join(F.broadcast(known), "__id").select("__id", "__label", "__text")  # at most max_rows ids and labels
    length = sample.agg(F.sum(F.char_length("__text"))).first()[0] or 0
    if length > MAX_CHARACTERS:
        sample = sample.where(draw < int(1_000_000 * min(1.0, max_rows / total) * MAX_CHARACTERS / length))
    return sample


def _frequent(sample: DataFrame, min_rows: int, gaps: tuple, within: np.ndarray | None = None) -> np.ndarray:
    """The features of these kinds that `min_rows` texts of the sample hold, sorted; bounded with the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, SLICE_BYTES):
            flat, ends = features_of(texts, gaps, shared.value)
            own, n = np.unique(np.concatenate([np.unique(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int32))], ["key", "n"])

    counts = sample.select("__text").mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") >= min_rows).select("key").toArrow()["key"].to_numpy())


def fit(
    df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = MAX_ROWS, min_rows: int = 3, shards: int = 1, rounds: int = 1, epochs: int = 5,
    alpha: float = 0.6, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1,
) -> Model:
    """Learn from the rows of `labels` alone. Without labelled texts the model gives every text 0.5."""
    sample = cut(_sample(df, labels, doc_id, text, label, max_rows))
    words = _frequent(sample, min_rows, ((),))
    keys = np.union1d(words, _frequent(sample, min_rows, ((1,), (2,), (3,)), words))
    session = df.sparkSession
    shared = session.sparkContext.broadcast(keys)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, texts in text_slices(batches, SLICE_BYTES):
            flat, ends = features_of(texts)
            rows = [np.unique(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            places = [np.append(_places(known, f), len(known)) for f in rows]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in places])])
            flat = np.concatenate([*places, np.zeros(0, dtype=np.int64)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))
            # in the order of an unsigned digest, whatever the partitions
            turns = pa.array([xxhash.xxh3_64_intdigest(str(i)) - (1 << 63) for i in batch.column(0).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([turns, batch.column(1), lists], ["turn", "label", "places"])

    pruned = cut(sample.mapInArrow(prune, "turn long, label int, places array<int>"))
    dealt = pruned.withColumn("shard", F.pmod("turn", F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "turn")
    state = (np.zeros(len(keys) + 1), np.zeros(len(keys) + 1))  # the last coordinate is the bias

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    def trainer(start):
        def train(labels: list[int], places: list[np.ndarray]) -> pa.RecordBatch:
            z, n = (x.copy() for x in start.value)
            for _ in range(epochs):
                for y, at in zip(labels, places, strict=True):
                    w = weights(z[at], n[at])
                    g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                    z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                    n[at] += g * g
            moved = np.flatnonzero((z != start.value[0]) | (n != start.value[1]))
            columns = moved, z[moved] - start.value[0][moved], n[moved] - start.value[1][moved]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["at", "z", "n"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Train each shard of a partition as its last row has come; what is held is one shard's places, as 32-bit numbers."""
            shard, labels, places = None, [], []
            for batch in batches:
                lists, own = batch.column(2), batch.column(1).to_pylist()
                ends = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
                flat = np.array(lists.flatten(), dtype=np.int32)
                for k, s in enumerate(batch.column(0).to_pylist()):
                    if s != shard and labels:
                        yield train(labels, places)
                        labels, places = [], []
                    shard = s
                    labels.append(own[k])
                    places.append(flat[ends[k] : ends[k + 1]])
            if labels:
                yield train(labels, places)

        return run

    for _ in range(rounds):
        steps = dealt.select("shard", "label", "places").mapInArrow(trainer(session.sparkContext.broadcast(state)), "at long, z double, n double")
        total = steps.groupBy("at").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toArrow()
        at = total["at"].to_numpy()
        state = tuple(x.copy() for x in state)
        state[0][at] += total["z"].to_numpy()
        state[1][at] += total["n"].to_numpy()
    w = weights(*state)
    kept = np.flatnonzero(w[:-1])
    return Model(keys[kept], w[kept], float(w[-1]))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of label 1 to every row; null and empty texts get the bias alone."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != out]
    shared = df.sparkSession.sparkContext.broadcast(model)
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, SLICE_BYTES):
            m = shared.value.margins(*features_of(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(1 / (1 + np.exp(-np.clip(m, -35, 35))))], [*keep, out])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` double"])
    return beside_text(df, keep, text).mapInArrow(run, schema)
