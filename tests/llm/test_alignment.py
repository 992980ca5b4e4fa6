"""Alignment of two tokenizers against sets of ends, with the libraries' own ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from millrace.llm import alignment
from millrace.llm.pieces import load_pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "aa", "b", "the", "ing", "É", "é", " ", "  ", "\n", "\t", "\x00", "▁", "\xa0", "　", "中", "文字", "😀", "<s>", "<|endoftext|>", "1", "2024",
         "...", "ation", ",", "Hello", "'s", " world", " of the"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    some = ["".join(r.choice(SIGNS[:12] + SIGNS[13:] if r.random() < 0.97 else SIGNS) for _ in range(r.randint(0, 30))) for _ in range(600)]
    return [*enumerate([*some, None, "", "a" * 5000, "word and " * 20_000]), (5, some[5]), (None, "the end"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, row int, pairs int").repartition(5)


def tokens(rows):
    """(id, ids of A, ids of B, [(a ids, b ids)] of each group)."""
    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    back = {v: k for k, v in alignment._byte_values().items()}
    values = {c: b for b, c in back.items()}
    for i, t in rows:
        want = (" " + (t or "")).encode()
        found, b = ta.encode(" " + (t or ""), add_special_tokens=False), tb.encode(t or "")
        a, raw_a = found.ids, [bytes(values[c] for c in x) for x in found.tokens]
        raw_b = [bytes([int(p[3:5], 16)]) if tb.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, map(tb.id_to_piece, b), strict=True)]
        if not t or b"".join(raw_a) != want or b"".join(raw_b) != want:
            yield i, [], [], []
            continue
        ends = []
        for raw in (raw_a, raw_b):
            at, own = 0, {}
            for k, x in enumerate(raw):
                at += len(x)
                own[at] = k + 1
            ends.append(own)
        groups, x, y = [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            groups.append((a[x : ends[0][e]], b[y : ends[1][e]]))
            x, y = ends[0][e], ends[1][e]
        yield i, a, b, groups


def expected(rows):
    every = list(tokens(rows))
    counts = Counter((a[-1], b[-1]) for *_, g in every for a, b in g)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, g in every:
        links = [(x[-1], y[-1]) for x, y in g]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best, total = sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)
        out.append((i, len(a), len(b), len(g), len(g), best, total, hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 50, 0])
def test_link_counts_against_brute_force(docs, rows, most):
    got = alignment.link_counts(docs, A, B, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_alignments(docs, rows):
    got = alignment.align(docs.withColumnRenamed("row", "alignment"), A, B).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "pairs", "alignment"}
    found = []
    for x in got:
        s, groups, i, j = x.alignment, [], 0, 0
        for a, b in zip(s.ends_a, s.ends_b, strict=True):
            groups.append((s.ids_a[i:a], s.ids_b[j:b]))
            i, j = a, b
        found.append((x.doc_id, s.ids_a, s.ids_b, groups))
    assert sorted(found, key=str) == sorted(tokens(rows), key=str)


def test_no_texts(docs):
    assert alignment.link_counts(docs.limit(0), A, B).count() == 0 == alignment.align(docs.limit(0), A, B).count()


def test_group_ends_against_sets():
    r = random.Random(3)
    for _ in range(2000):
        top = r.randint(1, 40)
        p = r.choice([0.1, 0.5, 0.9, 1])
        a, b = ([*(x for x in range(1, top) if r.random() < p), top] for _ in range(2))
        if r.random() < 0.3:
            b = a[:]
        both = sorted(set(a) & set(b))
        got = alignment.group_ends(np.array(a), np.array(b))
        assert [x.tolist() for x in got] == [[a.index(x) + 1 for x in both], [b.index(x) + 1 for x in both]]
    assert [len(x) for x in alignment.group_ends(np.zeros(0, dtype=int), np.zeros(0, dtype=int))] == [0, 0]


def test_both_encoders_of_the_byte_level_side_agree():
    """On every code point beside letters, digits and blanks, on long words, and where the quick one isn't used."""
    own = alignment.Aligner(A, B)
    assert own.quick is not None
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        if c < 0x3400 or 0xA000 <= c < 0x20000 and not 0xAC00 < c < 0xD7A0 or c % 97 == 0:
            t = f"a{chr(c)}1 {chr(c)}{chr(c)} {chr(c)}!"
            assert own.quick.encode_ordinary(t) == own.a.encode(t, add_special_tokens=False).ids, hex(c)
    for t in ("x" * 20_000, "é" * 20_000, " " * 499 + "y", "<|endoftext|>", " " * 5000, "\n" * 600 + "z"):
        assert own.encode_a([t])[0].tolist() == own.a.encode(" " + t, add_special_tokens=False).ids


def test_long_texts_are_cut_where_tokens_do_not_cross(monkeypatch):
    text = "word and, more 12 of it's " * 3000 + "x" * 50_000 + " and so on " * 3000
    whole = alignment.Aligner(A, B).encode([text, "", text[:100]])
    monkeypatch.setattr(alignment, "SLICE_BYTES", 500)
    cut = alignment.Aligner(A, B).encode([text, "", text[:100]])
    assert all((x == y).all() for s, t in zip(whole, cut, strict=True) for x, y in zip(s, t, strict=True))


def test_numbered_chunks_give_the_ids_of_the_chunk_table(monkeypatch):
    """Also where the numbers are forgotten between calls, blocks are short and chunks long."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, plain = alignment.ChunkIds(path), load_pieces(path)
    texts = ["one two two", "", "three  é▁x 𝒳", "x" * 300 + " one", "ab" * 100 + " " + "no spaces" * 40, " ", "two one " * 50]
    want = [x.tolist() for x in plain.encode(texts)]
    assert [x.tolist() for x in own.encode(texts)] == want == [x.tolist() for x in own.encode(texts)]
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", 2)
    monkeypatch.setattr(alignment, "BLOCK_CHUNKS", 3)
    assert [x.tolist() for x in own.encode(texts)] == want
    assert [own.encode([t])[0].tolist() for t in reversed(texts)] == want[::-1] and own.encode([]) == []
