"""Spelling variant grouping by a variable-length gram index.

Words are counted in the tasks that read the texts, so only counted distinct words are shuffled. Two
words are near if one inserted, deleted or replaced code point tells them apart. They are found
like this:

* Gram dictionary: a word stands between two end signs. A gram starts at each place with two
  signs and grows, up to LONGEST signs, for as long as it is frequent; so common grams are
  pruned in favour of their extensions. The frequent grams are at most MOST_FREQUENT a length
  and say all that is needed to cut any word.
* Decomposition: one gram of the dictionary from each place of a word. A gram depends on its own
  signs alone, so an edit changes only grams that hold its place.
* Bound: for each word the most grams that a single edit can affect. Near words share at least as
  many grams as either keeps unaffected. With 7 signs or more and grams of at most 4 that is at
  least one: the first and the last four signs never hold the same place.
* Lists: a word is entered in the inverted lists of its rarest grams only, one more than can be
  affected; near words meet in one of them. Long lists are dealt into cells. In a cell the lists
  of all grams are merged, pairs with fewer common grams than their bounds are dropped, the others verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_slices
from millrace.session import cut

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
SHORTEST, LONGEST = 2, 4
"""Signs of a gram."""
MOST_FREQUENT = 20_000
"""Frequent grams of a length, at most: those with more than 1 / MOST_FREQUENT of all places, and more than FEW words."""
FEW = 32
COUNTERS = 1 << 20
"""Slots in which grams are counted. Grams that share one count together, which only makes an order coarser or a list's cells smaller."""
LIST_ROWS = 128
"""Words of a list that stay together; a longer list is dealt into cells."""
BUCKET_ROWS = 8_192
"""Entries that are merged in one call, about."""
BEGIN, END = "\x02", "\x03"


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, change_every: int | None = None) -> DataFrame:
    """(word, n): the maximal runs of letters of at least `least` code points, A-Z lower-cased, and how often each occurs.

    `change_every` plants misspellings, for measuring: where it divides the crc32 of
    `<doc_id>:<run>`, that number picks a code point of the run, which is deleted first (a null
    id counts as ''). Null and empty texts have no words. Repeated rows count each.
    """
    rows = df.select(F.coalesce(df[doc_id].cast("string"), F.lit("")).alias("id"), df[text].alias("text"))
    pattern = re.compile(RUN + "{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            total: Counter = Counter()
            if change_every is None:
                for t in texts.to_pylist():
                    total.update(w.translate(TO_LOWER) for w in pattern.findall(t))
            else:
                for i, t in zip(batch.column(0).to_pylist(), texts.to_pylist(), strict=True):
                    begin = zlib.crc32(f"{i}:".encode())
                    for w, n in Counter(pattern.findall(t)).items():
                        w = w.lower() if w.isascii() else w.translate(TO_LOWER)
                        h = zlib.crc32(w.encode(), begin)
                        if h % change_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                        total[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())], ["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def signs(word: Column) -> Column:
    return F.concat(F.lit(BEGIN), word, F.lit(END))


def frequent_grams(words: DataFrame, most: int = MOST_FREQUENT, few: int = FEW) -> frozenset[str]:
    """The grams of SHORTEST to LONGEST - 1 signs that stand at more places than `few` and than 1 / `most` of all: fewer than `most` a length."""
    places = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    least = max(few, places // most) + 1
    found: set[str] = set()
    for length in range(SHORTEST, LONGEST):
        at = F.explode(F.sequence(F.lit(1), F.char_length("s") - length + 1))
        grams = words.select(signs(F.col("word")).alias("s")).where(F.char_length("s") >= length).select("s", at.alias("i"))
        counts = grams.groupBy(F.substring("s", F.col("i"), F.lit(length)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        found |= {r["g"] for r in counts.where(F.col("n") >= least).select("g").collect()}
    return frozenset(found)


def decompose(word: str, frequent: frozenset[str]) -> list[tuple[int, str]]:
    """(place, gram) for each place of a word between its end signs; a gram that reaches the end sign grows no further."""
    s = BEGIN + word + END
    out = []
    for i in range(len(s) - SHORTEST + 1):
        size = SHORTEST
        while size < LONGEST and i + size < len(s) and s[i : i + size] in frequent:
            size += 1
        out.append((i, s[i : i + size]))
    return out


def affected(length: int, grams: list[tuple[int, str]]) -> int:
    """The most grams that one inserted, deleted or replaced sign can touch in a word of `length` signs without its ends.

    An insertion touches the grams that hold the signs on both its sides, hence no more than an edit
    of one of these signs does; at least one of them is a sign of the word.
    """
    held = [0] * (length + 2)
    for i, g in grams:
        for p in range(i, i + len(g)):
            held[p] += 1
    return max(held[1 : length + 1], default=0)


def numbered(grams: list[tuple[int, str]]) -> list[str]:
    """The grams of a word as distinct names: a repeated gram also says which one of its kind it is."""
    out = [g for _, g in grams]
    if len(set(out)) == len(out):
        return out
    seen: Counter = Counter()
    out = []
    for _, g in grams:
        seen[g] += 1
        out.append(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


def _hashes(names: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(g.encode()) % COUNTERS for g in names), dtype=np.int64, count=len(names))


def _counters(rows: DataFrame) -> np.ndarray:
    """Sums of (slot, n) rows for all COUNTERS slots."""
    table = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most one row a slot
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[np.asarray(table.column("slot"))] = np.asarray(table.column("n"))
    return out


def _slots_of(batch_names: list[list[str]]) -> pa.RecordBatch:
    """(slot, n): how many of the words hold a gram of each slot."""
    slots, n = np.unique(_hashes([g for names in batch_names for g in names]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n)], ["slot", "n"])


def gram_counts(words: DataFrame, frequent: frozenset[str]) -> np.ndarray:
    """How many words hold a gram of each slot."""
    held = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _slots_of([numbered(decompose(w, held.value)) for w in batch.column(0).to_pylist()])

    return _counters(words.select("word").mapInArrow(run, "slot long, n long"))


def listed(words: DataFrame, frequent: frozenset[str], counts: np.ndarray) -> DataFrame:
    """(word, n, grams): the names of each word's rarest grams, one more than an edit can affect, without those of no other word."""
    held = words.sparkSession.sparkContext.broadcast((frequent, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = held.value
        for batch in batches:
            rare = []
            for w in batch.column(0).to_pylist():
                own = decompose(w, frequent)
                names = numbered(own)
                sizes = counts[_hashes(names)].tolist()
                first = sorted(zip(sizes, names, strict=True))[: affected(len(w), own) + 1]
                rare.append([g for n, g in first if n > 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rare, type=pa.list_(pa.string()))], ["word", "n", "grams"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, grams array<string>")


def in_cells(lists: DataFrame, rows: int) -> DataFrame:
    """(word, n, gram, cell_a, cell_b, block): every entry in every cell of its list.

    A list of n words (as its slot is counted, so at least as many as it has) is dealt by the digest
    of the words into blocks of about max(rows, 3 * sqrt(n)); the cell (a, a) holds block a, the cell (a, b) both.
    """
    spark = lists.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _slots_of(batch.column(0).to_pylist())

    held = spark.sparkContext.broadcast(_counters(lists.select("grams").mapInArrow(count, "slot long, n long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = held.value
        for batch in batches:
            flat = batch.column(2).flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column(2)), dtype=np.int64))
            size = sizes[_hashes(flat.to_pylist())]
            some = np.flatnonzero(size > 1)
            owner, size = owner[some], size[some]
            blocks = np.ceil(size / np.maximum(rows, np.ceil(3 * np.sqrt(size)))).astype(np.int64)
            digest = np.fromiter((zlib.crc32(w.encode(), 1) for w in batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)
            block = digest[owner] % blocks
            each = np.repeat(np.arange(len(some)), blocks)
            other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            own = block[each]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner[each])), batch.column(1).take(pa.array(owner[each])), flat.take(pa.array(some[each])),
                    *(pa.array(x.astype(np.int32)) for x in (np.minimum(own, other), np.maximum(own, other), own)),
                ],
                ["word", "n", "gram", "cell_a", "cell_b", "block"],
            )

    return lists.mapInArrow(run, "word string, n long, gram string, cell_a int, cell_b int, block int")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced sign tells the words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def sign_masks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The length of each word, and its signs as a set of 64 bits."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(size) - size
    return size, np.bitwise_or.reduceat(np.uint64(1) << (codes & np.uint64(63)), starts) if len(words) else np.zeros(0, dtype=np.uint64)


def may_be_near(size: np.ndarray, signs: np.ndarray, block: np.ndarray, two: bool) -> np.ndarray:
    """Which words of a cell need merging: one edit changes the length by one at most and two bits of the signs at most."""
    fits = (np.bitwise_count(signs[:, None] ^ signs) <= 2) & (np.abs(size[:, None] - size) <= 1)
    if two:
        fits &= block[:, None] != block
    else:
        np.fill_diagonal(fits, False)
    return fits.any(axis=0)


def merge_cell(words: list[str], grams: list[list[str]], keep: list[int], block: list[int], two: bool) -> Iterator[tuple[int, int]]:
    """Pairs of near words of a cell, by merging its inverted lists. `keep`: grams each word has unaffected. With `two` blocks only pairs across.

    All lists of the cell are merged at once: the product of the table of words and grams with
    itself says how many grams each two words have in common.
    """
    names: dict[str, int] = {}
    owner = np.repeat(np.arange(len(words)), [len(x) for x in grams])
    ids = np.array([names.setdefault(g, len(names)) for own in grams for g in own], dtype=np.int64)
    shared_by = np.bincount(ids)
    place = np.cumsum(shared_by > 1) - 1
    met = shared_by[ids] > 1
    held = np.zeros((len(words), int(place[-1]) + 1), dtype=np.float32)
    held[owner[met], place[ids[met]]] = 1
    bound, size, side = np.array(keep), np.array([len(w) for w in words]), np.array(block)
    near = (held @ held.T >= np.maximum(bound, bound[:, None])) & (np.abs(size - size[:, None]) <= 1)
    if two:
        near &= side != side[:, None]
    for k, j in np.argwhere(np.triu(near, 1)).tolist():
        if one_edit(words[k], words[j]):
            yield k, j


def near_pairs(words: DataFrame, most: int = MOST_FREQUENT, few: int = FEW, rows: int = LIST_ROWS) -> DataFrame:
    """(a, n_a, b, n_b), a < b: every pair of near words of the table (word, n) of distinct words of 7 code points or more.

    Shorter words are refused, as the bound would not hold; no words give no rows. Entries of a list
    are shuffled once, without the grams of their words, which are cut again in the cell.
    """
    if words.where(F.char_length("word") < 7).limit(1).count():
        raise ValueError("near_pairs takes words of 7 code points or more")
    frequent = frequent_grams(words, most, few)
    lists = cut(listed(words, frequent, gram_counts(words, frequent)))
    buckets = max(1, (lists.agg(F.sum(F.size("grams"))).first()[0] or 0) // BUCKET_ROWS)
    cells = in_cells(lists, rows).withColumn("bucket", F.pmod(F.xxhash64("gram", "cell_a", "cell_b"), F.lit(buckets)))
    held = words.sparkSession.sparkContext.broadcast(frequent)
    names = ["a", "n_a", "b", "n_b"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("gram", "ascending"), ("cell_a", "ascending"), ("cell_b", "ascending")])
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        keys = list(zip(columns["gram"], columns["cell_a"], columns["cell_b"], strict=True))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        w, n = columns["word"], columns["n"]
        found: set[tuple[str, int, str, int]] = set()
        size, signs = sign_masks(w)
        block = np.array(columns["block"])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                two = keys[a][1] != keys[a][2]
                some = (a + np.flatnonzero(may_be_near(size[a:b], signs[a:b], block[a:b], two))).tolist()
                if not some:
                    continue
                words = [w[k] for k in some]
                own = [decompose(x, held.value) for x in words]
                keep = [len(g) - affected(len(x), g) for x, g in zip(words, own, strict=True)]
                for k, j in merge_cell(words, list(map(numbered, own)), keep, block[some].tolist(), two):
                    one, other = (words[k], n[some[k]]), (words[j], n[some[j]])
                    found.add((*min(one, other), *max(one, other)))
        arrays = [pa.array([p[k] for p in found], type=t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))]
        return pa.Table.from_arrays(arrays, names)

    merged = cells.groupBy("bucket").applyInArrow(run, "a string, n_a long, b string, n_b long")
    return merged.distinct()


def variants(words: DataFrame, times: int = 10, **more: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the table (word, n).

    `form` is the near word of largest n (ties: the smallest in code-point order) if its n is at
    least `times` that of the word, else null. `root` is where forms lead in the end, the word itself
    without one. As n grows tenfold with each form, chains are short; they are followed by doubling.
    """
    pairs = cut(near_pairs(words, **more))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).union(pairs.select("b", "a", "n_a"))
    # binary strings compare by bytes, which is code-point order in UTF-8
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.encode("other", "UTF-8").alias("bytes"))).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = words.select("word", "n").join(near, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.decode("best.bytes", "UTF-8")).alias("form"), F.when(enough, -F.col("best.less")).cast("long").alias("form_n"))
    found = cut(found)
    roots = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        led = cut(led)
        roots = led.select("word", "root")
        if not led.where("moved").limit(1).count():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_n: int = 2, times: int = 10, change_every: int | None = None
) -> DataFrame:
    """`variants` of the words of 7 code points or more that occur `least_n` times or more in the texts.

    Null and empty texts have no words; without words the result has no rows. Repeated rows count each; other columns aren't read.
    """
    counted = word_counts(df, doc_id, text, change_every=change_every).where(F.col("n") >= least_n)
    return variants(cut(counted), times)
