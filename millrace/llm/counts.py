"""Token counts of a unigram vocabulary by trie-shared dynamic programming.

The distinct pre-tokens of a slice are put into a trie. Each new node gets the best score of
its prefix, and the fewest tokens that reach it, from the scores of its ancestors; so a prefix
that many words share is computed once. A pre-token's terminal node keeps its count, and a
document's count is the sum over its pre-tokens. Nothing is shuffled: a slice's words are
few, and frequent ones are known after the first slices.

Pre-tokens stand between white space and begin with the word mark, as in piece vocabularies.
A character that no piece covers costs as many tokens as it has UTF-8 bytes (byte fallback).
Scores are whole numbers, so equal segmentations are equal exactly; among the best ones, the
fewest tokens count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm.common import text_slices, words_of

MARK = "▁"
KEPT_NODES = 1_000_000
"""Trie nodes that a Python worker keeps; it starts anew when it has more."""
UNIT = 1_000_000
"""Scores are log-probabilities in millionths."""


def zipf_scores(pieces: list[str]) -> dict[str, int]:
    """Unigram log-probabilities from the order of a vocabulary: piece number r gets weight 1 / (r + 10).

    A merge-built vocabulary lists its pieces by falling frequency, which such a law describes;
    a vocabulary with unigram scores of its own may be given to `Trie` directly.
    """
    total = log(sum(1 / (r + 10) for r in range(len(pieces))))
    return {p: round(UNIT * (-log(r + 10) - total)) for r, p in enumerate(pieces)}


@functools.lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[str, ...]:
    """The ordinary pieces of a sentencepiece model file, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    return tuple(model.id_to_piece(i) for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))


class Trie:
    """Best scores and token counts of all prefixes seen so far."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0) - 10 * UNIT
        self.forget()

    def forget(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best: list[tuple[int, int]] = [(0, 0)]  # score and, negated, tokens: the larger is the better
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token; computes only the prefixes that no earlier word had."""
        if word in self.terminal:
            return self.terminal[word]
        node, path = 0, [self.best[0]]
        children, best, scores = self.children, self.best, self.scores
        for i, c in enumerate(word, 1):
            child = children[node].get(c)
            if child is None:
                child = children[node][c] = len(best)
                children.append({})
                score, less = path[i - 1]
                found = (score + self.unknown * len(c.encode()), less - len(c.encode()))
                for begin in range(max(0, i - self.longest), i):
                    own = scores.get(word[begin:i])
                    if own is not None:
                        score, less = path[begin]
                        found = max(found, (score + own, less - 1))
                best.append(found)
            node = child
            path.append(best[node])
        self.terminal[word] = -path[-1][1]
        return self.terminal[word]


@functools.lru_cache(maxsize=2)
def load_trie(path: str) -> Trie:
    return Trie(zipf_scores(list(load_pieces(path))))


def token_counts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row; zero for a null, empty or blank text.

    Repeated rows are counted each, a null id is carried, and other columns aren't read.
    """
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load_trie(path)
        for batch, texts in text_slices(batches):
            words = words_of(pc.utf8_split_whitespace(texts))
            if len(trie.best) > KEPT_NODES:
                trie.forget()
            distinct = words.distinct.to_pylist()
            per_word = np.fromiter((trie.count(MARK + w) for w in distinct), dtype=np.int64, count=len(distinct))
            totals = np.concatenate([[0], np.cumsum(per_word[words.codes])])[words.offsets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.offsets)), pa.array(np.diff(totals))], ["doc_id", "n_pretokens", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_pretokens long, n_tokens long")
