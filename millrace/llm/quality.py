"""Quality by positive-unlabelled learning with the non-negative risk.

A text is described by a few dozen shape features (repetition, shouting, symbols, lines);
none of them reads a label, the language, the source or the id. A linear model f minimises

    p * mean_P loss(f)  +  max(0, mean_U loss(-f) - p * mean_P loss(-f))  +  ridge

over the trusted positives P and the texts U, where p is the class prior (Kiryo et al., 2017).
U are all texts, whatever is known of them, as the risk asks for a sample of the whole: with the
labelled ones left out it would hold too few positives for the prior. With the logistic loss the sum without max is convex, so Newton steps are used
while the second term is positive; where it falls below zero, the step goes against its
gradient, as the non-negative estimator asks for. Every step is one pass over the written
features: sums are made in tasks, added up by Spark, and only one small matrix comes back.
All positives and all texts take part.

The prior is the share of positives among the training labels when these hold both classes,
and otherwise the estimate of Elkan and Noto: the mean over U of a positive-versus-unlabelled
model, divided by its mean over P.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import beside_text, one_label, text_slices, words_of
from millrace.session import cut

SYMBOLS = "[^\\p{L}\\p{N}\\p{M}.,;:'\"?()-]"
FEATURES = 24
SLICE_BYTES = 2 << 20
"""Text that a task describes at a time."""


@dataclass
class Model:
    weights: list[float]
    centre: list[float]
    scale: list[float]
    prior: float


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[offsets])


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of shape features per text; all zero for a text without words."""
    words = words_of(pc.utf8_split_whitespace(texts))
    d, codes, offsets = words.distinct, words.codes, words.offsets
    count = lambda pattern: np.asarray(pc.count_substring_regex(d, pattern), dtype=np.float64)
    length = np.asarray(pc.utf8_length(d), dtype=np.float64)
    upper, digits, symbols = count("\\p{Lu}"), count("\\p{N}"), count(SYMBOLS)
    letters, bangs = count("\\p{L}"), count("!")
    n = np.diff(offsets).astype(np.float64)
    some = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(n)), np.diff(offsets))
    mean = lambda per_word: _sums(per_word[codes], offsets) / some
    chars = np.maximum(_sums(length[codes], offsets), 1)
    share = lambda per_word: _sums(per_word[codes], offsets) / chars

    def distinct_of(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owners))
        k, o = keys[order], owners[order]
        first = np.ones(len(k), dtype=bool)
        first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[first], minlength=len(n)).astype(np.float64)

    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = codes[:-1][inner] * max(len(d), 1) + codes[1:][inner]
    pair_count = np.maximum(n - 1, 1)
    lines = pc.split_pattern(texts, "\n")
    of_line = lines.values.dictionary_encode()
    ends = np.asarray(lines.offsets, dtype=np.int64) - lines.offsets[0].as_py()
    line_doc = np.repeat(np.arange(len(n)), np.diff(ends))
    line_count = np.maximum(np.diff(ends).astype(np.float64), 1)
    repeated = 1 - distinct_of(np.asarray(of_line.indices, dtype=np.int64), line_doc) / line_count
    shout = ((letters >= 2) & (upper == letters)).astype(np.float64)
    lone = ((length == symbols) & (length > 0)).astype(np.float64)
    ending = np.asarray(pc.match_substring_regex(d, SYMBOLS + "$"), dtype=np.float64)
    stops = np.asarray(pc.match_substring_regex(d, "[.?]$"), dtype=np.float64)
    ratios = [
        1 - distinct_of(codes, doc) / some, 1 - distinct_of(pairs, doc[inner]) / pair_count, _sums(same, offsets) / some,
        mean(shout), mean(lone), mean(ending), mean((bangs > 0).astype(np.float64)), share(symbols), share(upper), share(digits), repeated,
    ]
    x = np.stack([
        *ratios, *(np.minimum(1, 8 * r) for r in ratios[2:8]),
        mean((symbols > 1).astype(np.float64)), mean((digits > 0).astype(np.float64)), mean(stops), np.minimum(chars / some, 40) / 10,
        np.log1p(n), 1 / np.maximum(n, 1), line_count / np.maximum(n, line_count),
    ], axis=1)
    x[n == 0] = 0
    return x


def described(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Replace the text by its feature array `x`, beside the `keep` columns."""
    keep = [c for c in (keep or []) if c != "x"]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, SLICE_BYTES):
            x = features_of(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, type=pa.int32()), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], [*keep, "x"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "x array<float>"])
    return beside_text(df, keep, text).mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _totals(rows: DataFrame, make) -> np.ndarray:
    """Add up `make(x, known)`, a vector per batch, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch.column(0)), np.asarray(batch.column(1).fill_null(0)) == 1)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    sums = rows.select("x", "__label").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    return sums["v"].to_numpy()


def fit(rows: DataFrame, prior: float | None = None, steps: int = 12, ridge: float = 1e-3) -> Model:
    """Fit on `x` and `__label` (1: trusted positive, 0: trusted negative, null: unlabelled).

    Trusted negatives serve the prior alone. Without rows or positives the model is constant.
    """
    size = FEATURES + 1

    def moments(x, known):
        return np.concatenate([[len(x), known.sum()], x.sum(0), (x * x).sum(0)])

    marks = rows.groupBy("__label").count().toArrow().to_pylist()
    counts = {r["__label"]: r["count"] for r in marks}
    if not counts.get(1):
        return Model([0.0] * size, [0.0] * FEATURES, [1.0] * FEATURES, prior if prior is not None else 0.5)
    m = _totals(rows, moments)
    centre = m[2 : 2 + FEATURES] / m[0]
    scale = np.sqrt(np.maximum(m[2 + FEATURES :] / m[0] - centre**2, 0))
    scale[scale < 1e-6] = 1.0
    place = lambda x: np.hstack([np.clip((x - centre) / scale, -6, 6), np.ones((len(x), 1))])

    def newton(make_step, w, most):
        for _ in range(most):
            step = make_step(w)
            w = w - step
            if np.abs(step).max() < 1e-3:
                break
        return w

    penalty = np.append(np.full(FEATURES, ridge), 1e-6)

    def gathered(w):
        """Counts, loss sums, gradient sums of P and U, and U's curvature, at the weights w."""

        def make(x, known):
            a = place(x)
            f = a @ w
            s = 1 / (1 + np.exp(-np.clip(f, -35, 35)))
            p = a[known]
            loss = np.logaddexp(0, f)
            head = [len(p), len(a), loss[known].sum(), loss.sum()]
            spread = (a * (s * (1 - s))[:, None]).T @ a
            return np.concatenate([head, p.sum(0), (p * s[known][:, None]).sum(0), (a * s[:, None]).sum(0), spread.ravel()])

        return _totals(rows, make)

    if prior is None:
        positive, negative = counts.get(1, 0), counts.get(0, 0)
        if negative:
            prior = positive / (positive + negative)
        else:

            def against(w):
                t = gathered(w)
                n = t[1]
                g = (t[4 + 2 * size : 4 + 3 * size] - t[4 : 4 + size]) / n + penalty * w
                return np.linalg.solve(t[4 + 3 * size :].reshape(size, size) / n + np.diag(penalty + 1e-4), g)

            w = newton(against, np.zeros(size), steps)

            def means(x, known):
                s = 1 / (1 + np.exp(-np.clip(place(x) @ w, -35, 35)))
                return np.array([known.sum(), len(x), s[known].sum(), s.sum()])

            t = _totals(rows, means)
            prior = float(np.clip((t[3] / max(t[1], 1)) / max(t[2] / t[0], 1e-9), 0.05, 0.95))

    def risk_step(w):
        t = gathered(w)
        np_, nu = t[0], max(t[1], 1)
        p_mean, p_soft, u_soft = t[4 : 4 + size] / np_, t[4 + size : 4 + 2 * size] / np_, t[4 + 2 * size : 4 + 3 * size] / nu
        curve = t[4 + 3 * size :].reshape(size, size) / nu + np.diag(penalty + 1e-4)
        if t[3] / nu - prior * t[2] / np_ < 0:  # the negatives' risk can't be below zero: go back up
            return -0.1 * np.linalg.solve(curve, u_soft - prior * p_soft)
        step = np.linalg.solve(curve, u_soft - prior * p_mean + penalty * w)
        return step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))

    w = newton(risk_step, np.zeros(size), steps)
    return Model(w.tolist(), centre.tolist(), scale.tolist(), float(prior))


def train(described_rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> tuple[DataFrame, Model]:
    """Attach the labels to described rows, write them and fit: (the written rows, the model)."""
    known = one_label(labels, doc_id, label)
    joined = described_rows.join(known, described_rows[doc_id] == known["__id"], "left").drop("__id")
    rows = cut(joined)
    return rows, fit(rows)


def _probability(x: np.ndarray, model: Model) -> np.ndarray:
    w = np.array(model.weights)
    f = np.clip((x - np.array(model.centre)) / np.array(model.scale), -6, 6) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(f, -35, 35)))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row, in one pass over the texts; null counts as empty."""
    keep = [c for c in df.columns if c != out]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, SLICE_BYTES):
            found = _probability(features_of(texts).astype(np.float32).astype(np.float64), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found)], [*keep, out])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` double"])
    return beside_text(df, keep, text).mapInArrow(run, schema)


def scored(rows: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add the probability of label 1 computed from `x`."""
    keep = [c for c in rows.columns if c not in ("x", "__label", out)]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(keep))) if batch.num_rows else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(_probability(x, model))], [*keep, out])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` double"])
    return rows.select(*keep, "x").mapInArrow(run, schema)
