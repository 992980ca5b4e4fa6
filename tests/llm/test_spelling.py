"""Spelling variants against neighbours found by deleting each code point."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import spelling


def brute(rows, every):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += len(w) >= 7
    c = {w: n for w, n in c.items() if n > 1}
    holes = defaultdict(set)
    for w in c:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
    form, near = {}, {}
    for w, n in c.items():
        found = set()
        for k in range(len(w) + 1):
            found |= holes.get((w[:k], w[k:]), set()) | (holes[w[:k], w[k + 1 :]] | ({w[:k] + w[k + 1 :]} & c.keys()) if k < len(w) else set())
        near[w] = found - {w}
        best = min(near[w], key=lambda x: (-c[x], x), default=None)
        form[w] = best if best and c[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), c.get(form[w])) for w, n in c.items())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    base = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(7, 14))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab", "abababababab"]
    out = []
    for i in range(1200):
        own = []
        for _ in range(20):
            w = base[min(int(r.expovariate(0.15)), len(base) - 1)]
            for _ in range(r.choice([0] * 15 + [1, 1, 1, 2, 3])):
                k = r.randint(0, len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcE") + w[k:], w[:k] + r.choice("abÉz") + w[k + 1 :]])
            own.append(w)
        out.append((i, r.choice([" ", ", ", "\n", "1"]).join(own)))
    return out + [(None, "Someword Someword someword"), (1, None), (2, ""), (3, "repeated"), (3, "repeated"), (4, "x" * 3000), (5, "x" * 3000 + " " + "x" * 2999)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id long, text string, word string, n int").repartition(5)


@pytest.mark.parametrize("most,few,size", [(20_000, 32, 256), (20, 2, 8), (20_000, 1, 16)])
def test_against_brute_force(spark, docs, rows, most, few, size):
    words = spelling.cut(spelling.word_counts(docs, change_every=31).where("n >= 2"))
    got = [tuple(x) for x in spelling.variants(words, most=most, few=few, rows=size).collect()]
    want = brute(rows, 31)
    assert sorted(got) == want and sum(x[1] is not None for x in want) > 300 and any(x[2] not in (x[0], x[1]) for x in want)


def test_without_planted_misspellings_and_without_words(spark, docs, rows):
    assert sorted(tuple(x) for x in spelling.spelling_variants(docs).collect()) == brute(rows, None)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0 == spelling.spelling_variants(docs.where("text = ''")).count()
    with pytest.raises(ValueError):
        spelling.near_pairs(spark.createDataFrame([("short", 5)], "word string, n long"))


def test_ties_take_the_smallest_form_and_chains_are_followed(spark):
    words = [("zzzzzza", 30), ("zzzzzzb", 30), ("zzzzzzÿ", 2), ("kkkkkkkk", 1000), ("kkkkkkk", 100), ("kkkkkkl", 10), ("kkkkkklm", 1), ("kkkkkklmn", 1)]
    got = {x.word: (x.form, x.root, x.n_near, x.form_n) for x in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["zzzzzzÿ"] == ("zzzzzza", "zzzzzza", 2, 30) and got["zzzzzza"] == (None, "zzzzzza", 2, None)
    assert got["kkkkkklm"] == ("kkkkkkl", "kkkkkkkk", 2, 10) and got["kkkkkkl"] == ("kkkkkkk", "kkkkkkkk", 2, 100)
    assert got["kkkkkklmn"] == (None, "kkkkkklmn", 1, None)


def test_an_edit_leaves_as_many_grams_as_the_bound_says():
    """Every single edit of words over few signs, with dictionaries of all kinds."""
    r = random.Random(2)
    for _ in range(300):
        w = "".join(r.choice("ab") for _ in range(r.randint(7, 9)))
        grams = {w[i : i + k] for i in range(len(w)) for k in (2, 3)}
        frequent = frozenset(g for g in grams | {"\x02a", "\x02ab", "a\x03"} if r.random() < 0.6)
        own = spelling.decompose(w, frequent)
        keep = len(own) - spelling.affected(len(w), own)
        assert keep >= 1
        edits = [w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in ("", "a", "b", "c") for d in (0, 1)]
        for e in edits:
            if spelling.one_edit(w, e):
                shared = set(spelling.numbered(own)) & set(spelling.numbered(spelling.decompose(e, frequent)))
                assert len(shared) >= keep, (w, e)
