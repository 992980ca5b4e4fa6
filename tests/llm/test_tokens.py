"""BPE, packing and token counts against the library, round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, counts, packing
from millrace.llm.common import text_slices

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["a", "aa", "b", "The", "ING", "É", "é", "é", "ß", "İ", "Σ", "ΑΣ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "'s", "'LL", "'",
         "<|endoftext|>", "<|", "7", "²", "½", "٣", "中", "文字", "😀", "ǅ", "ﬁ", "\x00", "!", "...", "ŉ", "ª", "ͅ", "token"]


def texts():
    r = random.Random(2)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["", "a" * 5000, "the cat sat " * 3000]


def test_encode_and_decode_as_the_library():
    lib, own, every = Tokenizer.from_file(PATH), bpe.WordBpe(PATH), texts()
    flat, ends = own.encode(pa.array(every, type=pa.large_string()))
    for i, e in enumerate(lib.encode_batch(every, add_special_tokens=False)):
        ids = flat[ends[i] : ends[i + 1]]
        assert ids.tolist() == e.ids, every[i]
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_what_the_splitter_takes_for_white_space_is_covered():
    """Every character at which the kernel splits is white space for the vocabulary too, but for four that are handled apart."""
    lib = Tokenizer.from_file(PATH)
    every = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    split = [c for c, w in zip(every, pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in every])), strict=True) if len(w) == 2]
    assert {c for c in split if lib.normalizer.normalize_str(f"a{c}b") != "a b"} == set("\x1c\x1d\x1e\x1f")


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    own, every = bpe.WordBpe(PATH), texts()[:200]
    once = own.encode(pa.array(every, type=pa.large_string()))[0]
    again = np.concatenate([own.encode(pa.array([t], type=pa.large_string()))[0] for t in every])
    assert (once == again).all()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts()[::20] + [None, "", " \n"])] + [(0, texts()[0], 1, "x"), (None, "no id", 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, length string").repartition(4)


def test_encode_in_spark(docs):
    lib = Tokenizer.from_file(PATH)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == docs.count() and set(got[0].asDict()) == {"doc_id", "text", "length", "ids", "decoded"}
    for x in got:
        ids = lib.encode(x.text or "", add_special_tokens=False).ids
        assert x.ids == ids and x.decoded == lib.decode(ids, skip_special_tokens=False)
    for x in bpe.encoding_digests(docs.join(docs.select("doc_id", "text"), ["doc_id", "text"]).dropDuplicates(["doc_id"]), PATH).collect():
        assert len(x.ids_sha256) == 64
    one = bpe.encoding_digests(docs.where("doc_id = 3"), PATH).first()
    ids = lib.encode(docs.where("doc_id = 3").first().text, add_special_tokens=False).ids
    assert one.n_tokens == len(ids) and one.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_packing(spark, docs, tmp_path):
    lib = Tokenizer.from_file(PATH)
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.pack(whole, PATH, longest=64)
    got = packed.collect()
    assert len({x.sequence_id for x in got}) == len(got) and all(x.offset == 0 for x in got)
    assert all(x.length == 1 << x.bucket and x.length <= 64 and len(x.ids) == x.length for x in got)
    by = {}
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == len(by.setdefault(x.doc_id, []))
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, dtype="<u4").tobytes())
        by[x.doc_id] += x.ids
    texts = {x.doc_id: x.text or "" for x in whole.collect()}
    assert by == {i: lib.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    assert all(x.doc_tokens == len(by[x.doc_id]) for x in got)
    packing.write_buckets(packed, str(tmp_path / "out"))
    back = {x.doc_id: x.ids for x in packing.unpack(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert back == {i: ids[:-1] for i, ids in by.items()}


def test_packing_odd_rows(docs):
    got = packing.pack(docs, PATH, with_ids=False)
    assert "ids" not in got.columns
    rows = got.where("doc_id is null or doc_id = 0").collect()
    assert len({x.sequence_id for x in rows}) == len(rows) and sum(x.doc_id == 0 and x.start == 0 for x in rows) == 2
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, longest=100)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 2048, 2049, 100_003])
def test_binary_lengths(n):
    out = packing.binary_lengths(n, 64)
    assert sum(out) == n and out == sorted(out, reverse=True) and all(x & (x - 1) == 0 for x in out) and out.count(64) == n // 64


def brute_count(word, scores, unknown):
    best = [(0, 0)]
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        ways = [(best[i - 1][0] + unknown * size, best[i - 1][1] - size)]
        ways += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores]
        best.append(max(ways))
    return -best[-1][1]


def test_counts_against_brute_force(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = counts.zipf_scores(list(counts.load_pieces(path)))
    unknown = min(scores.values()) - 10 * counts.UNIT
    every = texts()[::20] + [None, ""]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(every)] + [(None, "no id", 0)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {x.doc_id: x for x in counts.token_counts(docs, path).collect()}
    for i, t in enumerate(every):
        words = pc.utf8_split_whitespace(pa.array([t or ""]))[0].as_py()
        words = [w for w in words if w]
        short = [w for w in words if len(w) < 200]
        assert got[i].n_pretokens == len(words)
        if len(short) == len(words):
            assert got[i].n_tokens == sum(brute_count(counts.MARK + w, scores, unknown) for w in words)
    assert got[None].n_pretokens == 2 and counts.token_counts(docs.limit(0), path).count() == 0


def test_counts_as_the_library(spark):
    """The library's unigram model with the same pieces and scores, on words that the pieces cover."""
    from tokenizers import models

    scores = counts.zipf_scores(list(counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))))
    lib = Tokenizer(models.Unigram([("<unk>", -100.0), *((p, s / counts.UNIT) for p, s in scores.items())], 0, False))
    trie = counts.Trie(scores)
    words = [counts.MARK + w for w in ("the reading inconsequential quickly zebras analogous thhaerti edoution onheesstor a").split()]
    assert [trie.count(w) for w in words] == [len(lib.encode(w).ids) for w in words]
    nodes = len(trie.best)
    trie.count(counts.MARK + "readings")
    assert len(trie.best) == nodes + 1


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_pydict({"n": [1, 2, 3, 4], "t": ["ab", None, "c" * 50, "d"]})
    parts = list(text_slices([batch], 10))
    assert [p.column(0).to_pylist() for p, _ in parts] == [[1, 2], [3], [4]] and parts[0][1].to_pylist() == ["ab", ""]
