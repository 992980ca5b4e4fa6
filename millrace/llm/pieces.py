"""SentencePiece BPE encoding by a table of distinct chunks, and decoding.

White space is a marker character inside the pieces of such a vocabulary, and no piece holds a
marker after another character. So a text falls apart before each run of markers: merges never
cross there. It also falls apart around characters that no piece holds (they become bytes), and a
longer chunk between any two neighbouring characters that no piece holds side by side. Each
distinct chunk is segmented once by the merge rule (best score first, equal scores from left to
right) and kept in a worker's table; the ids of a text are joined back from the table by position.

The rules above are read from the vocabulary; a file whose pieces cross markers, or whose
normaliser changes more than spaces, is refused. The path of the file is a parameter and must be
readable on every executor.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import beside_text, text_slices

MARK = "▁"
KEPT_CHUNKS = 400_000
"""Chunks that a Python worker remembers; it starts anew when it has more."""
LONG_CHUNK = 64
"""Longer chunks are cut between characters that never stand side by side in a piece, and not remembered."""
BLOCK_CHUNKS = 200_000
"""Chunks of a text that are looked up at a time."""
UNKNOWN = " ⁇ "
Entry = tuple[int, str, str, list[int]]
"""How many ids a chunk has, the ids as text, the chunk as it is decoded, and the ids."""

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        if lib.encode("½  á", out_type=str)[:1] == ["½"] or lib.decode(lib.encode("  Ａ á")) != "  Ａ á":
            raise ValueError("the vocabulary must add a leading marker and keep texts as they are")
        every = range(lib.get_piece_size())
        self.pieces = [lib.id_to_piece(i) for i in every]
        self.control = frozenset(i for i in every if lib.is_control(i))
        self.unknown = lib.unk_id()
        self.byte_value = {i: int(self.pieces[i][3:5], 16) for i in every if lib.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_value.items()}
        normal = [i for i in every if i not in self.control and i != self.unknown and i not in self.byte_value]
        self.ids = {self.pieces[i]: i for i in normal}
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary must fall back to bytes and must not cross markers")
        scores = sorted({lib.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.size = len(self.pieces)
        # (left id, right id) as one number -> (rank, id of the merged piece)
        self.merges: dict[int, tuple[int, int]] = {}
        self.beside: set[str] = set()
        for piece, made in self.ids.items():
            self.beside.update(piece[k : k + 2] for k in range(len(piece) - 1))
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    self.merges[a * self.size + b] = (place[lib.get_score(made)], made)
        known = "".join(sorted({c for p in self.ids for c in p} - {MARK}))
        escaped = re.escape(known)
        self.pattern = re.compile(f"{MARK}*[{escaped}]+|{MARK}+|[^{escaped}{MARK}]+")
        keys = np.array(sorted(self.merges), dtype=np.int64)
        self.merge_keys, self.no_rank = keys, len(scores)
        self.merge_ranks = np.array([self.merges[k][0] for k in keys.tolist()], dtype=np.int64)
        self.merge_made = np.array([self.merges[k][1] for k in keys.tolist()], dtype=np.int64)
        self.char_ids = np.full(0x110000, -1, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.texts = [None if i in self.byte_value else self.shown([i]) for i in every]
        self.numbers = [str(i) for i in every]
        self.table: dict[str, Entry] = {}

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk: neighbouring symbols are merged, the best score first, equal scores from left to right."""
        found = self.ids.get(chunk)
        symbols = array("i", [self.ids.get(c, -1) for c in chunk])
        n = len(symbols)
        if n == 1 and found is not None:
            return [found]
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        merges, size = self.merges, self.size
        agenda = []
        for i in range(n - 1):
            if symbols[i] >= 0 and symbols[i + 1] >= 0:
                best = merges.get(symbols[i] * size + symbols[i + 1])
                if best:
                    agenda.append(best[0] << 32 | i)
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            best = merges.get(symbols[i] * size + symbols[j])
            if not best or best[0] != entry >> 32:  # one of the two was merged meanwhile
                continue
            symbols[i], symbols[j] = best[1], -2
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if symbols[k] >= 0 and (best := merges.get(symbols[i] * size + symbols[k])):
                    heapq.heappush(agenda, best[0] << 32 | i)
            h = before[i]
            if h >= 0 and symbols[h] >= 0 and (best := merges.get(symbols[h] * size + symbols[i])):
                heapq.heappush(agenda, best[0] << 32 | h)
        out: list[int] = []
        for i, s in enumerate(symbols):
            if s >= 0:
                out.append(s)
            elif s == -1:
                out += [self.byte_ids[b] for b in chunk[i].encode()]
        return out

    def shown(self, ids: Iterable[int]) -> str:
        """The text of ids with every marker as a space, the leading one included."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_value:
                raw.append(self.byte_value[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "each_byte"))
                raw = bytearray()
            if i == self.unknown:
                out.append(UNKNOWN)
            elif i not in self.control:
                out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "each_byte"))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """As the library does: the marker that encoding put in front of a text is taken away."""
        ids = list(ids)
        first = next((i for i in ids if i not in self.control), None)
        text = self.shown(ids)
        led = first is not None and first != self.unknown and first not in self.byte_value and self.pieces[first].startswith(MARK)
        return text[1:] if led else text

    def segment_all(self, chunks: list[str]) -> list[list[int]]:
        """`segment` for many short chunks: in each round every chunk that still can makes its next merge."""
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        symbols = self.char_ids[np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)]
        signs = np.flatnonzero(symbols == -1)
        symbols[signs] = -1 - signs  # so that a character without an id can be told later
        owner = np.repeat(np.arange(len(chunks)), lengths)
        done_symbols, done_owners = [], []
        rank, made = self._pairs(symbols, np.append(symbols[1:], -1), np.append(owner[1:] == owner[:-1], False))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            over = best >> 32 == self.no_rank
            if over.any():
                sizes = np.diff(np.append(starts, len(symbols)))
                gone = np.repeat(over, sizes)
                done_symbols.append(symbols[gone])
                done_owners.append(owner[gone])
                left = ~gone
                best = best[~over] & 0xFFFFFFFF
                best = best - np.cumsum(gone)[best]
                symbols, owner, rank, made = symbols[left], owner[left], rank[left], made[left]
            else:
                best = best & 0xFFFFFFFF
            symbols[best] = made[best]
            keep = np.ones(len(symbols), dtype=bool)
            keep[best + 1] = False
            best = best - np.arange(len(best))  # each chunk before it lost one symbol
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            touched = np.zeros(len(symbols), dtype=bool)
            touched[best] = touched[np.maximum(best - 1, 0)] = True
            changed = np.flatnonzero(touched)
            follow = np.minimum(changed + 1, len(symbols) - 1)
            rank[changed], made[changed] = self._pairs(symbols[changed], symbols[follow], (owner[changed] == owner[follow]) & (follow > changed))
        if not done_symbols:
            return []
        owner, symbols = np.concatenate(done_owners), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(chunks))).tolist()
        flat = symbols[order].tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if len(signs):
            text = "".join(chunks)
            for k in np.unique(owner[symbols < 0]).tolist():
                out[k] = [i for s in out[k] for i in ([s] if s >= 0 else [self.byte_ids[b] for b in text[-1 - s].encode()])]
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each two symbols merge to; the last rank where they don't."""
        keys = np.where(together & (a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        met = self.merge_keys[at] == keys
        return np.where(met, self.merge_ranks[at], self.no_rank), np.where(met, self.merge_made[at], -1)

    def _parts(self, chunk: str) -> list[str]:
        """A long chunk, cut wherever two characters stand side by side in no piece."""
        cuts = [0, *(k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in self.beside), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _chunks(self, marked: str) -> Iterator[list[str]]:
        """The chunks of a text with its markers, a block at a time, long ones cut further."""
        if len(marked) <= 4 * BLOCK_CHUNKS:
            blocks: Iterable[list[str]] = [self.pattern.findall(marked)]
        else:
            found = (m[0] for m in self.pattern.finditer(marked))
            blocks = iter(lambda: list(islice(found, BLOCK_CHUNKS)), [])
        for chunks in blocks:
            if max(map(len, chunks)) > LONG_CHUNK:
                chunks = [p for c in chunks for p in (self._parts(c) if len(c) > LONG_CHUNK else [c])]
            yield chunks

    def _learn(self, missing: Iterable[str]) -> dict[str, Entry]:
        """Segment distinct chunks; the short ones are remembered, all are returned."""
        short, long = [], []
        for c in missing:
            (short if len(c) <= LONG_CHUNK else long).append(c)
        if len(self.table) + len(short) > KEPT_CHUNKS:
            self.table.clear()
        found = {}
        for chunks, ids in ((short, self.segment_all(short)), (long, map(self.segment, long))):
            for c, own in zip(chunks, ids, strict=True):
                try:
                    shown = "".join([self.texts[i] for i in own])
                except TypeError:  # bytes among them
                    shown = self.shown(own)
                found[c] = len(own), ",".join(map(self.numbers.__getitem__, own)), shown, own
        self.table.update((c, found[c]) for c in short)
        return found

    def entries(self, texts: list[str]) -> Iterator[tuple[int, bool, list[Entry]]]:
        """(number of the text, whether it begins here, entries of its chunks in order); a long text comes in blocks, an empty one not at all."""
        held: list[tuple[int, bool, list[str]]] = []
        size = 0

        def joined() -> Iterator[tuple[int, bool, list[Entry]]]:
            table = self.table
            missing = {c for _, _, chunks in held for c in chunks if c not in table}
            if missing:
                known = {c: table[c] for _, _, chunks in held for c in chunks if c in table}
                table = known | self._learn(missing)
            for k, begins, chunks in held:
                yield k, begins, [table[c] for c in chunks]
            held.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            for part, chunks in enumerate(self._chunks(MARK + text.replace(" ", MARK))):
                held.append((k, not part, chunks))
                size += len(chunks)
                if size > BLOCK_CHUNKS:
                    yield from joined()
                    size = 0
        yield from joined()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for k, _, own in self.entries(texts):
            parts[k].append(np.array(list(chain.from_iterable([e[3] for e in own])), dtype=np.int32))
        return [np.concatenate(p) if p else np.zeros(0, dtype=np.int32) for p in parts]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """How many ids each text has, the digest of the ids as comma-joined decimals, and that of the decoded text."""
        counts, ids, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for k, begins, own in self.entries(texts):
            n, shown, pieces, _ = zip(*own, strict=True)
            counts[k] += sum(n)
            ids[k].update((("" if begins else ",") + ",".join(shown)).encode())
            decoded[k].update("".join(pieces)[begins:].encode())
        return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in zip(counts, ids, decoded, strict=True)]


@functools.lru_cache(maxsize=2)
def load_pieces(path: str) -> PieceBpe:
    return PieceBpe(path)


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in keep), more])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each text as an array column. `keep`: the columns to carry (all when none are named).

    A null or empty text has no ids. A carried column named like `ids` is replaced. Repeated rows
    are encoded each. A text of any length is encoded whole; memory grows with the longest stretch
    that can't be cut (some 100 bytes a character) and with nothing else.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_pieces(path)
        for batch, texts in text_slices(batches):
            own = bpe.encode(texts.to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = np.concatenate(own) if own else np.zeros(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], [*keep, ids])

    return beside_text(df, keep, text).mapInArrow(run, _schema(df, keep, f"`{ids}` array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each array of ids: null for null ids, '' for none; a null or unknown number among them is an unknown piece."""
    keep = [c for c in df.columns if c != out]
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_pieces(path)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            known = ([i if i is not None and 0 <= i < bpe.size else bpe.unknown for i in v] if v is not None else None for v in lists)
            texts = pa.array([None if v is None else bpe.decode(v) for v in known], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), texts], [*keep, out])

    return df.select(*keep).mapInArrow(run, _schema(df, keep, f"`{out}` string"))


def encoding_digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    The ids are hashed as decimals joined by commas and never leave the task. A null text counts as
    empty: no ids, and the digests of nothing. Other columns aren't read.
    """
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_pieces(path)
        for batch, texts in text_slices(batches):
            n, ids, decoded = zip(*bpe.digests(texts.to_pylist()), strict=True)
            columns = [batch.column(0), pa.array(n, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(decoded, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, _schema(rows, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string"))
