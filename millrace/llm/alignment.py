"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes differently. The ends of their tokens are two rising lists
that finish at the same byte; where an end stands in both, a group closes. Most of a text is one
token against one, so the lists agree entry by entry at a fixed shift between their indices. The
aligner compares stretches of the lists at the current shift, twice as long each time, until one
differs, resolves the group there by stepping through both lists,
and goes on at the new shift.

Corpus-wide counts of linked id pairs come from a grouped sum. The commonest pairs (bounded by
KEPT_PAIRS whatever the corpus holds) are looked up where the documents are; only the rarer pairs
of a document are shuffled to their counts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_turn, text_slices
from millrace.llm.pieces import BLOCK_CHUNKS, KEPT_CHUNKS, LONG_CHUNK, MARK, PieceBpe
from millrace.session import cut

SLICE_BYTES = 1 << 20
"""Text that is tokenized at a time; longer texts are cut where tokens can't cross, if there is such a place."""
KEPT_PAIRS = 200_000
"""Commonest pairs that every worker holds, at most."""
FIRST_PROBE = 8
"""Entries that are compared first at a new shift; each further probe is twice as long."""
LEVELS = 16
"""Steps per doubling in which counts are told apart when the commonest pairs are chosen."""
# A single space between ASCII letters begins a token of the byte-level splitter, whatever stands further off.
BORDER = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
BLANKS = re.compile(r"\s{500}")
"""Runs of white space that the quick encoder's splitter has no stack for."""
# Fixed value: the pattern of byte-level splitting.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def group_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many entries of `a` and of `b` each group closes with. Both arrays rise strictly and end alike."""
    a, b = a.tolist(), b.tolist()
    n = len(a)
    i = j = 0
    runs: list[tuple[int, int, int]] = []  # first group's ends in both, and how many groups follow one to one
    while i < n:
        ahead, step = i, FIRST_PROBE
        while i < n and a[i : i + step] == b[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        if i >= n:
            i, j = n, len(b)
        else:
            while step > 1:
                step //= 2
                if a[i : i + step] == b[j : j + step]:
                    i, j = i + step, j + step
        if i > ahead:
            runs.append((ahead + 1, j - (i - ahead) + 1, i - ahead))
        while i < n and (x := a[i]) != (y := b[j]):
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            runs.append((i, j, 1))
    if not runs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first_a, first_b, sizes = np.array(runs, dtype=np.int64).T
    return in_turn(first_a, sizes), in_turn(first_b, sizes)


class ChunkIds(PieceBpe):
    """Ids alone by distinct chunks: a chunk is known by its number, and the ids of all stand in one array."""

    def __init__(self, path: str):
        super().__init__(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Segment new distinct chunks and number them."""
        short, long = [c for c in chunks if len(c) <= LONG_CHUNK], [c for c in chunks if len(c) > LONG_CHUNK]
        found = [*self.segment_all(short), *map(self.segment, long)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.number.update(zip(short + long, range(len(self.number), len(self.number) + len(found)), strict=True))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and how many each has. At most KEPT_CHUNKS numbers and 16 ids for each are kept for the next call."""
        numbers = list(map(self.number.get, chunks))
        if None in numbers:
            if len(self.number) > KEPT_CHUNKS or len(self.flat) > 16 * KEPT_CHUNKS:
                self.forget()
            self.learn([c for c in dict.fromkeys(chunks) if c not in self.number])
            numbers = list(map(self.number.__getitem__, chunks))
        numbers = np.array(numbers, dtype=np.int64)
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        return self.flat[in_turn(self.starts[numbers], sizes)].astype(np.int64), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a long text is worked through in blocks."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[str] = []
        owners: list[tuple[int, int]] = []  # text, and how many chunks are held with its own

        def settle() -> None:
            if held:
                ids, sizes = self.of_chunks(held)
                upto = np.concatenate([[0], np.cumsum(sizes)])
                begin = 0
                for k, end in owners:
                    parts[k].append(ids[upto[begin] : upto[end]])
                    begin = end
            held.clear()
            owners.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            for chunks in self._chunks(MARK + text.replace(" ", MARK)):
                held += chunks
                owners.append((k, len(held)))
                if len(held) > BLOCK_CHUNKS:
                    settle()
        settle()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts]


class Aligner:
    """Two vocabularies: byte-level BPE (A) and SentencePiece BPE (B)."""

    def __init__(self, path_a: str, path_b: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.quick = _quick(path_a)
        self.b = ChunkIds(path_b)
        back = _byte_values()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = self.b.pieces
        self.bytes_b = [bytes([self.b.byte_value[i]]) if i in self.b.byte_value else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of A of each text, with a space before it."""
        return self._encode_a(texts)[0]

    def _encode_a(self, texts: list[str]) -> tuple[list[np.ndarray], set[int]]:
        """Ids of A of each text, with a space before it, and which texts the quick encoder didn't do alone."""
        parts: list[str] = []
        owner: list[int] = []
        for k, text in enumerate(texts):
            text, at = " " + text, 0
            while len(text) - at > SLICE_BYTES:
                border = BORDER.search(text, at + SLICE_BYTES // 2)
                if not border:
                    break
                parts.append(text[at : border.start()])
                owner.append(k)
                at = border.start()
            parts.append(text[at:])
            owner.append(k)
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        others: set[int] = set()
        for k, part in zip(owner, parts, strict=True):
            plain = self.quick and not BLANKS.search(part)
            if not plain:
                others.add(k)
            found = self.quick.encode_to_numpy(part, disallowed_special=()) if plain else self.a.encode(part, add_special_tokens=False).ids
            ids[k].append(np.asarray(found, dtype=np.int64))
        return [np.concatenate(x) for x in ids], others

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of each text; none where their bytes aren't those of the text with a space before it.

        B's chunks are spelled out piece by piece or byte by byte, so its bytes can only differ by a marker
        that stands in the text itself. The quick encoder splits every text without a gap into bytes that it merges. For
        both the number of bytes is compared; the bytes themselves where A's other encoder may be at work.
        """
        none = np.zeros(0, dtype=np.int64)
        (ids_a, others), ids_b = self._encode_a(texts), self.b.encode(texts)
        for k, text in enumerate(texts):
            want = (" " + text).encode()
            same = text and MARK not in text and len(want) == self.size_a[ids_a[k]].sum() == self.size_b[ids_b[k]].sum()
            if same and k in others:
                same = b"".join(map(self.bytes_a.__getitem__, ids_a[k].tolist())) == want
            if not same:
                ids_a[k] = ids_b[k] = none
        return ids_a, ids_b

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids of A and of B stand before the end of each group. Several texts may stand one after another."""
        return group_ends(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]))

    @functools.cached_property
    def spellings(self) -> list[str]:
        """Of id i of A: at 2 * i with a comma, at 2 * i + 1 with a bar; then the same of B with a semicolon."""
        ends = [(i, e) for i in range(len(self.bytes_a)) for e in ",|"] + [(i, e) for i in range(len(self.bytes_b)) for e in ",;"]
        return [f"{i}{e}" for i, e in ends]

    def spelled(self, ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[str]:
        """The parts of `a1,a2|b1;a3|b2,b3;`, one for each id, in this order."""
        last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        last_a[in_a - 1] = last_b[in_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out = np.zeros(len(ids_a) + len(ids_b), dtype=np.int64)
        out[np.arange(len(ids_a)) + np.concatenate([[0], in_b])[group_a]] = 2 * ids_a + last_a
        out[np.arange(len(ids_b)) + in_a[group_b]] = 2 * (len(self.bytes_a) + ids_b) + last_b
        return list(map(self.spellings.__getitem__, out.tolist()))


def _byte_values() -> dict[str, int]:
    """The byte that each printable character stands for in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _quick(path: str):
    """A second encoder of the same vocabulary, three times as fast; None where its rules don't follow from the file.

    It splits by the usual byte-level pattern and merges by rank, so the ids must rise with the merges.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splitter, vocab = spec["pre_tokenizer"] or {}, spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space") and spec["normalizer"] is None
    if not plain or made != sorted(made) or len(made) + 256 + len(spec["added_tokens"]) < len(vocab):
        return None
    import tiktoken

    back = _byte_values()
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def load_aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _slices(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str):
    """For each slice of texts: the rows, and for each text its ids and group ends."""
    own = load_aligner(path_a, path_b)
    for batch, texts in text_slices(batches, SLICE_BYTES):
        ids_a, ids_b = own.encode(texts.to_pylist())
        all_a, all_b = np.concatenate(ids_a), np.concatenate(ids_b)
        in_a, in_b = own.groups(all_a, all_b)
        ends_a, ends_b = np.cumsum([len(x) for x in ids_a]), np.cumsum([len(x) for x in ids_b])
        ends = np.searchsorted(in_a, ends_a, side="right")
        yield own, batch, all_a, all_b, in_a, in_b, ends_a, ends_b, ends


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", out: str = "alignment", keep: list[str] | None = None) -> DataFrame:
    """Add the alignment of each text: struct(ids_a, ids_b, ends_a, ends_b), all arrays.

    `ends_a` and `ends_b` say how many ids of each side stand before the end of each group, so a
    group's last ids are linked. A null or empty text, and one whose bytes a vocabulary doesn't
    give back, has empty arrays. `keep`: the columns to carry (all when none are named); one named
    like `out` is replaced. Repeated rows are aligned each.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != out]
    types = dict(df.dtypes)
    name = "__text"
    while name in keep:
        name += "_"
    inner = pa.struct([(c, pa.list_(pa.int32())) for c in ("ids_a", "ids_b", "ends_a", "ends_b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch, all_a, all_b, in_a, in_b, ends_a, ends_b, ends in _slices(batches, path_a, path_b):
            found = []
            for k in range(batch.num_rows):
                a, b, g = (slice(e[k - 1] if k else 0, e[k]) for e in (ends_a, ends_b, ends))
                found.append({"ids_a": all_a[a], "ids_b": all_b[b], "ends_a": in_a[g] - a.start, "ends_b": in_b[g] - b.start})
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, type=inner)], [*keep, out])

    arrays = "struct<ids_a:array<int>,ids_b:array<int>,ends_a:array<int>,ends_b:array<int>>"
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` {arrays}"])
    return df.select(*keep, df[text].alias(name)).mapInArrow(run, schema)


def linked_pairs(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times).

    Every token has bytes, so the last tokens of a group are its one link. `pairs` holds the
    distinct linked id pairs of the text, as a * 2^20 + b, and `times` how often each is linked.
    `groups_sha256` is the digest of the groups as `a1,a2|b1;a3|b2,b3`, '' without tokens. A null or
    empty text, and one whose bytes a vocabulary doesn't give back, has no tokens. One row per input row.
    """
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("__text"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, batch, all_a, all_b, in_a, in_b, ends_a, ends_b, ends in _slices(batches, path_a, path_b):
            links = all_a[in_a - 1] << 20 | all_b[in_b - 1]
            parts = own.spelled(all_a, all_b, in_a, in_b)
            digests, pairs, times, sizes = [], [], [], []
            a = b = g = 0
            for x, y, e in zip(ends_a.tolist(), ends_b.tolist(), ends.tolist(), strict=True):
                met, n = np.unique(links[g:e], return_counts=True)
                pairs.append(met)
                times.append(n)
                sizes.append(len(met))
                shown = "".join(parts[a + b : x + y])[:-1]
                digests.append(hashlib.sha256(shown.encode()).hexdigest() if shown else "")
                a, b, g = x, y, e
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            n_groups = pa.array(np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(ends_a, prepend=0)), pa.array(np.diff(ends_b, prepend=0)), n_groups, n_groups,
                    pa.array(digests, type=pa.string()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs).astype(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times).astype(np.int32))),
                ],
                names,
            )

    kind = dict(rows.dtypes)["doc_id"]
    counts = "n_a long, n_b long, n_groups long, n_links long"
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of all texts hold each id pair, and whether no pair of its B id has more."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = cut(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")))
    own_b = F.col("pair").bitwiseAND((1 << 20) - 1)
    most = counts.groupBy(own_b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", own_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def commonest(counts: DataFrame, most: int = KEPT_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The pairs with at least some count, `most` at most: pairs in order, their counts, whether best; and that count."""
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()  # at most 64 * LEVELS rows
    total, least = 0, 1 << 62
    for s in sizes:
        total += s["rows"]
        if total > most:
            break
        least = s["least"]
    kept = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    return (*(np.asarray(kept.column(c).combine_chunks()) for c in ("pair", "n")), kept.column("best").combine_chunks().to_numpy(zero_copy_only=False), least)


def link_counts(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", most: int = KEPT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    A pair's count is how many links of all texts hold it. `n_best` counts a text's links whose pair
    has the highest count of all pairs with the same B id (ties included); `count_sum` adds up the
    counts of all its links. Zeros and '' for a text without tokens. Null and repeated ids are rows of their own.
    """
    spark = df.sparkSession
    linked = cut(linked_pairs(df, path_a, path_b, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(linked))
    pairs, totals, best, least = commonest(counts, most)
    held = spark.sparkContext.broadcast((pairs, totals, best))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, totals, best = held.value
        for batch in batches:
            own, times = batch.column(len(kept)), batch.column(len(kept) + 1)
            offsets = np.asarray(own.offsets, dtype=np.int64)
            flat, n = (np.asarray(c.flatten(), dtype=np.int64) for c in (own, times))
            offsets = offsets - offsets[0]
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), dtype=bool)
            sums = [np.where(known, n * (t[at] if len(pairs) else 0), 0) for t in (best, totals)]
            n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(s)])[offsets]) for s in sums)
            rest = np.concatenate([[0], np.cumsum(~known)])[offsets].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~known])) for x in (flat, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(n_best), pa.array(count_sum), *lists], names)

    names = [*kept, "n_best", "count_sum", "rest", "rest_times"]
    types = dict(linked.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "n_best long, count_sum long, rest array<long>, rest_times array<long>"])
    found = cut(linked.select(*kept, "pairs", "times").mapInArrow(run, schema))
    rare = found.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    rare = rare.join(counts.where(F.col("n") < least), "pair")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    rows = found.join(more, "row", "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).cast("long").alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).cast("long").alias("count_sum"), "groups_sha256",
    )
