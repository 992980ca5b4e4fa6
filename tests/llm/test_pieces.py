"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from millrace.llm import pieces
from millrace.llm.pieces import PieceBpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "aa", "b", "the", "ing", "É", "é", "ß", " ", "  ", " " * 17, "\n", "\t", "\x00", "▁", "\xa0", "　", "中", "文字", "😀", "<s>", "</s>",
         "<unk>", "<0x0A>", "ation", "1", "2024", "...", "==", "//", "Σ", "при", "ﬁ", "�", "tion of the", "that,"]


@pytest.fixture(scope="module")
def lib():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return PieceBpe(PATH)


def texts():
    r = random.Random(4)
    joined = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    other = ["".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x17F), r.randint(0x4E00, 0x4FFF), r.randint(1, 0x2FFF)])) for _ in range(80)) for _ in range(500)]
    return joined + other + ["", "a" * 5000, " " * 5000, "ab" * 3000 + " x", "the cat sat " * 3000, "the\n" * 3000]


def expected(lib, text):
    ids = lib.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_encode_and_decode_as_the_library(lib, own):
    every = texts()
    for t, ids, digest in zip(every, own.encode(every), own.digests(every), strict=True):
        assert ids.tolist() == lib.encode(t), t
        assert own.decode(ids.tolist()) == lib.decode(lib.encode(t)) and digest == expected(lib, t)


def test_any_ids_are_decoded_as_the_library_does(lib, own):
    r = random.Random(5)
    mark = lib.piece_to_id("▁")
    for _ in range(5000):
        ids = [r.choice([r.randint(0, 300), r.randint(0, 31999), mark]) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_rounds_and_agenda_agree(own):
    """Segmenting many chunks in rounds against one chunk after another."""
    chunks = sorted({c for t in texts() for c in own.pattern.findall("▁" + t.replace(" ", "▁")) if len(c) <= pieces.LONG_CHUNK})
    assert own.segment_all(chunks) == [own.segment(c) for c in chunks] and own.segment_all([]) == []


def test_small_tables_and_blocks_change_nothing(lib, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 5)
    monkeypatch.setattr(pieces, "BLOCK_CHUNKS", 7)
    own, every = PieceBpe(PATH), texts()[::40] + ["one two three four five six seven eight nine ten " * 5]
    assert own.digests(every) == [expected(lib, t) for t in every]


def test_in_spark(spark, lib):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts()[::20] + [None, "", " \n"])] + [(0, "twice", 1, "x"), (0, "twice", 1, "x"), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, __text string").repartition(4)
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "__text", "ids", "decoded"}
    for x in got:
        assert x.ids == lib.encode(x.text or "") and x.decoded == lib.decode(x.ids)
    digests = pieces.encoding_digests(docs, PATH)
    assert sorted(map(str, map(tuple, digests.collect()))) == sorted(str((i, *expected(lib, t or ""))) for i, t, *_ in rows)
    assert pieces.encoding_digests(docs.limit(0), PATH).count() == 0 == pieces.encode(docs.limit(0), PATH).count()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 40_000, 5])], "doc_id long, ids array<int>")
    assert {x.doc_id: x.decoded for x in pieces.decode(odd, PATH).collect()} == {1: None, 2: "", 3: lib.decode([0, 0, 5])}
