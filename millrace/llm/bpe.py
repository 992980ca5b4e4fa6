"""BPE encoding by a pair occurrence index, and decoding.

A slice's new words are laid end to end as one array of symbols with links to the
neighbours. The index maps the rank of each pair to all positions where the pair stands.
Active ranks are taken from a heap in ascending order; all occurrences of a rank are merged
at once, and the pairs that the merges make are added to the lists of their ranks. As each
word always has its lowest active rank merged first, and equal ranks from left to right, the
result is that of merging every word by itself.

The vocabulary is a file in the JSON form of the tokenizers library: BPE with an end-of-word
suffix over bytes, lower case, white space dropped. Its path is a parameter and must be
readable on every executor (the file is part of the installation, as libraries are).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm.common import beside_text, in_turn, text_slices, words_of

KEPT_WORDS = 800_000
"""Words whose ids a Python worker remembers; it starts anew when it has more."""

# Fixed values of the pre-tokenizer: the contractions that stand alone, and what counts as white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = " \t\n\x0b\x0c\r\x85\xa0"
PLAIN_END = 0x250
"""Characters below it that are not U+0130 need no normalisation and lower-case one by one."""


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars, spare = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in chars:
            chars[b] = chr(spare)
            spare += 1
    return [chars[b] for b in range(256)]


def _plain_pattern() -> re.Pattern:
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers = of("L"), of("N")
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{re.escape(SPACE)}{letters}{numbers}]+")


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        chars = _byte_chars()
        self.path = path
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merges = list(zip(left.tolist(), right.tolist(), (vocab[a + b] for a, b in pairs), strict=True))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in (*vocab.items(), *self.special.items()):
            self.tokens[i] = token
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.plain = _plain_pattern()
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    @functools.cached_property
    def library(self):
        """The tokenizers library, for normalising and splitting rare scripts."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words, one word after another, and how many each has."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes) - 1
        symbol = self.inner[raw]
        symbol[ends] = self.final[raw[ends]]
        after = np.arange(1, len(raw) + 1)
        after[ends] = -1
        before = np.arange(-1, len(raw) - 1)
        before[ends[:-1] + 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            """Index the pairs that start at these positions."""
            rank = self._ranks_of(symbol[positions], symbol[after[positions]])
            known = rank >= 0
            rank, positions = rank[known], positions[known]
            order = np.argsort(rank, kind="stable")
            rank, positions = rank[order], positions[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            firsts = rank[np.concatenate([[0], cuts])].tolist() if len(rank) else []
            for r, part in zip(firsts, np.split(positions, cuts), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        add(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            a, b, made = self.merges[r]
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            right = after[at]
            at = at[(symbol[at] == a) & (right >= 0) & (symbol[right] == b)]
            if a == b and len(at) > 1:  # the same symbol can't be merged with both neighbours
                taken, kept = set(), []
                for p in at.tolist():
                    if p not in taken:
                        kept.append(p)
                        taken.add(int(after[p]))
                at = np.array(kept, dtype=np.int64)
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbol[at], symbol[gone] = made, -1
            after[at] = follow
            more = follow >= 0
            before[follow[more]] = at[more]
            lefts = before[at]
            add(np.unique(np.concatenate([lefts[lefts >= 0], at[after[at] >= 0]])))
        alive = symbol >= 0
        counts = np.add.reduceat(alive, ends - sizes + 1, dtype=np.int64) if len(words) else np.zeros(0, dtype=np.int64)
        return symbol[alive], counts

    def _pretokens(self, chunk: str) -> list[bytes | int]:
        """The byte strings to merge, and ids of special tokens, of a chunk."""
        if self.special_pattern and "<|" in chunk and (hits := list(self.special_pattern.finditer(chunk))):
            out, at = [], 0
            for hit in hits:
                out += [*self._pretokens(chunk[at : hit.start()]), self.special[hit[0]]]
                at = hit.end()
            return out + self._pretokens(chunk[at:])
        if not chunk:
            return []
        if chunk.isascii() or (max(chunk) < chr(PLAIN_END) and "İ" not in chunk):
            lower = chunk.lower()
            return [lower.encode()] if lower.isalpha() else [p.encode() for p in self.plain.findall(lower)]
        normal = self.library.normalizer.normalize_str(chunk)
        return [self._raw(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    @functools.cached_property
    def _bytes_of(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(_byte_chars())}

    def _raw(self, shown: str) -> bytes:
        return bytes(self._bytes_of[c] for c in shown)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks and remember them."""
        split = [self._pretokens(c) for c in chunks]
        distinct = [p for p in dict.fromkeys(p for parts in split for p in parts) if isinstance(p, bytes)]
        place = {p: i for i, p in enumerate(distinct)}
        ids, counts = self.merge(distinct) if distinct else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        extra = {t: len(distinct) + i for i, t in enumerate(self.special.values())}
        ids = np.concatenate([ids, np.array([*extra], dtype=np.int64)])
        counts = np.concatenate([counts, np.ones(len(extra), dtype=np.int64)])
        starts = np.cumsum(counts) - counts
        place |= extra
        order = np.array([place[p] for parts in split for p in parts], dtype=np.int64)
        pieces = np.array([len(parts) for parts in split], dtype=np.int64)
        flat = ids[in_turn(starts[order], counts[order])]
        ends = np.concatenate([[0], np.cumsum(counts[order])])[np.cumsum(pieces)]
        lengths = np.diff(ends, prepend=0)
        base = len(self.index)
        self.index.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, ends - lengths + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and where each text's ids begin and end."""
        if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():  # the split takes these for white space
            words = words_of(pa.array([re.findall("[^ \t\n\r]+", t) for t in texts.to_pylist()], type=pa.list_(pa.large_string())))
        else:
            words = words_of(pc.utf8_split_whitespace(texts))
        if len(self.index) > KEPT_WORDS:
            self._forget()
        chunks = words.distinct.to_pylist()
        if new := [c for c in chunks if c not in self.index]:
            self._learn(new)
        known = np.fromiter(map(self.index.__getitem__, chunks), dtype=np.int64, count=len(chunks))[words.codes]
        lengths = self.lengths[known]
        ends = np.concatenate([[0], np.cumsum(lengths)])[words.offsets]
        return self.flat[in_turn(self.starts[known], lengths)], ends

    def decode(self, ids: np.ndarray) -> str:
        """As the library does without a decoder of its own: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def load_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each text as an array column. `keep`: the columns to carry (all when none are named).

    A null or empty text has no ids. A carried column named like `ids` is replaced.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != ids]
    rows = beside_text(df, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch, texts in text_slices(batches):
            flat, ends = bpe.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], [*keep, ids])

    return rows.mapInArrow(run, _schema(df, keep, f"{ids} array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null for null ids."""
    keep = [c for c in df.columns if c != out]
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            texts = [None if v is None else bpe.decode(np.asarray(v.values)) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, type=pa.string())], [*keep, out])

    return df.select(*keep).mapInArrow(run, _schema(df, keep, f"{out} string"))


def encoding_digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    The ids are hashed as little-endian unsigned 32-bit integers and never leave the task.
    """
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch, texts in text_slices(batches):
            flat, ends = bpe.encode(texts)
            hashes, decoded = [], []
            for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = flat[begin:end]
                hashes.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends)), pa.array(hashes, type=pa.string()), pa.array(decoded, type=pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, _schema(rows, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in keep), more])
