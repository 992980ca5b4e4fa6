"""How much of a reference text a candidate text repeats: n-gram overlap, BLEU and ROUGE."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import normalise, words
from millrace.operators.bounds import settle
from millrace.operators.joins import meet


def gram_matches(pairs: DataFrame, keys: Sequence[str], candidate: str, reference: str, longest: int) -> DataFrame:
    """(keys, n, matched, candidates, references) for n-grams of 1 to `longest` words.

    `keys` must be unique. A gram counts as often as both texts hold it. The totals of grams follow
    from the numbers of words; only grams that both texts hold leave their row, and those are counted
    by aggregation with map-side combine, so a long text is spread like any other rows. A pair
    without words, or with a null text, has zeros.
    """
    none = F.array().cast("array<string>")
    split = lambda c: F.coalesce(words(normalise(F.col(c))), none)
    of = lambda w: F.when(F.size(w) >= F.col("n"), F.transform(F.sequence(F.lit(1), F.size(w) - F.col("n") + 1), lambda i: F.array_join(F.slice(w, i, F.col("n")), " "))).otherwise(none)
    texts = pairs.select(*keys, split(candidate).alias("__a"), split(reference).alias("__b"), F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n"))
    listed = texts.select(*keys, "n", of(F.col("__a")).alias("__a"), of(F.col("__b")).alias("__b")).select("*", F.array_intersect("__a", "__b").alias("__s"))
    sizes = listed.select(*keys, "n", F.size("__a").cast("long").alias("candidates"), F.size("__b").cast("long").alias("references"))
    held = lambda c: F.filter(c, lambda g: F.array_contains("__s", g))
    sides = listed.select(*keys, "n", F.explode(F.array(F.struct(F.lit(True).alias("own"), held("__a").alias("g")), F.struct(F.lit(False).alias("own"), held("__b").alias("g")))).alias("s"))
    grams = sides.select(*keys, "n", "s.own", F.explode("s.g").alias("gram"))
    own = F.col("own")
    counted = grams.groupBy(*keys, "n", "gram").agg(F.count_if(own).alias("c"), F.count_if(~own).alias("r"))
    met = counted.select(*keys, "n", F.least("c", "r").alias("matched"), F.lit(0).cast("long").alias("candidates"), F.lit(0).cast("long").alias("references"))
    both = sizes.select(*keys, "n", F.lit(0).cast("long").alias("matched"), "candidates", "references").unionByName(met)
    return both.groupBy(*keys, "n").agg(*[F.sum(c).alias(c) for c in ("matched", "candidates", "references")])


def _of(n: int, name: str) -> Column:
    return F.max(F.when(F.col("n") == n, F.col(name)))


def bleu(pairs: DataFrame, keys: Sequence[str], candidate: str, reference: str, longest: int = 4) -> DataFrame:
    """(keys, bleu): the geometric mean of the clipped precisions times the brevity penalty.

    Without smoothing: zero when any length has no match.
    """
    matches = gram_matches(pairs, keys, candidate, reference, longest)
    wide = matches.groupBy(*keys).agg(
        *[_of(n, "matched").alias(f"m{n}") for n in range(1, longest + 1)],
        *[_of(n, "candidates").alias(f"c{n}") for n in range(1, longest + 1)],
        _of(1, "references").alias("r1"),
    )
    every, total = F.lit(True), F.lit(0.0)
    for n in range(1, longest + 1):
        every = every & (F.col(f"m{n}") > 0)
        total = total + F.log(F.col(f"m{n}") / F.col(f"c{n}"))
    brevity = F.when(F.col("c1") > F.col("r1"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r1") / F.nullif(F.col("c1"), F.lit(0))))
    return wide.select(*keys, F.when(every, brevity * F.exp(total / longest)).otherwise(0.0).alias("bleu"))


def held_grams(texts: DataFrame, named: Sequence[str], longest: int) -> DataFrame:
    """(named, n, side, gram) from rows of (named, __c, __r): every gram of 1 to `longest` words of the
    candidate `__c` (side 0) and those of each reference in `__r` (side 1 on) that the candidate holds too.

    A reference gram that its candidate lacks matches nothing, so it never leaves its row.
    """
    none = F.array().cast("array<string>")
    of = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    size = F.size("__c")
    held = F.array_distinct(F.flatten(F.array(*[F.when(size >= n, of(F.col("__c"), n)).otherwise(none) for n in range(1, longest + 1)])))
    sides = texts.select(*named, held.alias("__g"), F.posexplode(F.concat(F.array("__c"), "__r")).alias("side", "w"))
    sized = sides.select("*", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.size("w") >= F.col("n"))
    listed = sized.select(*named, "n", "side", of(F.col("w"), F.col("n")).alias("__a"), "__g")
    shared = listed.select(*named, "n", "side", "__a", F.when(F.col("side") > 0, F.array_intersect("__a", "__g")).alias("__s"))
    kept = F.when(F.col("side") == 0, F.col("__a")).otherwise(F.filter("__a", lambda g: F.array_contains("__s", g)))
    return shared.select(*named, "n", "side", F.explode(kept).alias("gram"))


MATCH_WORDS = 1_000_000
"""Words of candidates and references that are matched at a time; a pair with more makes up a piece of its own."""


def clipped(candidates: pa.Array, references: pa.Array, longest: int) -> np.ndarray:
    """(pairs, longest): the grams of 1 to `longest` words in each candidate, each counted as often as the reference that holds it most often does.

    `candidates` are lists of words, `references` lists of such lists. Words and grams are numbered
    without hashing, so none are confused; a reference gram is looked up only where the shorter one before it was found.
    """
    texts = references.flatten()
    c_sizes, r_sizes = (np.asarray(x.value_lengths(), dtype=np.int64) for x in (candidates, texts))
    pair_of_text = np.repeat(np.arange(len(candidates)), np.asarray(references.value_lengths(), dtype=np.int64))
    coded = pa.concat_arrays([candidates.flatten(), texts.flatten()]).dictionary_encode()
    words, kinds = np.asarray(coded.indices, dtype=np.int64), len(coded.dictionary) + 1
    split = int(c_sizes.sum())
    c_words, r_words = words[:split], words[split:]
    out = np.zeros((len(candidates), longest), dtype=np.int64)
    # Places in the candidates and in the references, the number of the gram that begins there, and what follows it in its text.
    c_at, c_left, c_gram = np.arange(split), np.repeat(np.cumsum(c_sizes), c_sizes) - np.arange(split), np.repeat(np.arange(len(candidates)), c_sizes)
    r_at, r_left = np.arange(len(r_words)), np.repeat(np.cumsum(r_sizes), r_sizes) - np.arange(len(r_words))
    r_text = np.repeat(np.arange(len(texts)), r_sizes)
    c_pair, r_gram = c_gram.copy(), pair_of_text[r_text]
    for n in range(1, longest + 1):
        fits = c_left >= n
        c_at, c_left, c_gram, c_pair = c_at[fits], c_left[fits], c_gram[fits], c_pair[fits]
        fits = r_left >= n
        r_at, r_left, r_text, r_gram = r_at[fits], r_left[fits], r_text[fits], r_gram[fits]
        if not len(c_at) or not len(r_at):
            break
        known, first, c_gram, times = np.unique(c_gram * kinds + c_words[c_at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        asked = r_gram * kinds + r_words[r_at + n - 1]
        place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        found = known[place] == asked
        r_at, r_left, r_text, r_gram = r_at[found], r_left[found], r_text[found], place[found]
        if not len(r_at):
            break
        each, held = np.unique(r_gram * len(texts) + r_text, return_counts=True)
        most = np.zeros(len(known), dtype=np.int64)
        np.maximum.at(most, each // len(texts), held)
        out[:, n - 1] = np.bincount(c_pair[first], np.minimum(times, most), len(candidates)).astype(np.int64)
    return out


def row_matches(texts: DataFrame, by: Sequence[str], longest: int) -> DataFrame:
    """(by, __m) from rows of (by, __c, __r): an array of how many grams of 1, 2, ... `longest` words match, clipped as in `corpus_bleu`.

    No built-in function counts the entries of two arrays against each other without taking them apart, so
    rows go over in Arrow batches; the time grows with the words, and nothing but `longest` numbers comes back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, r = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            ends = np.asarray(r.offsets, dtype=np.int64)
            inner = np.asarray(r.values.offsets, dtype=np.int64)[ends]
            sizes = np.cumsum(np.diff(inner) + np.diff(ends) + np.asarray(c.value_lengths(), dtype=np.int64))
            begin = 0
            while begin < batch.num_rows:
                before = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + MATCH_WORDS, side="right")))
                found = clipped(c.slice(begin, end - begin), r.slice(begin, end - begin), longest)
                at = pa.array(np.arange(end - begin + 1) * longest, type=pa.int32())
                kept = [batch.column(i).slice(begin, end - begin) for i in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(at, pa.array(found.ravel()))], names=[*names, "__m"])
                begin = end

    rows = texts.select(*by, "__c", "__r")
    names = rows.columns[:-2]
    kinds = T.StructType([*rows.schema.fields[:-2], T.StructField("__m", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, kinds)


def corpus_bleu(pairs: DataFrame, keys: Sequence[str], by: Sequence[str], candidate: str, references: str, longest: int = 4) -> DataFrame:
    """(by, candidates, references, bleu) of whole groups of pairs, with any number of references each.

    `keys` must be unique, `references` is an array of texts. A gram of a candidate counts as often as
    the reference that holds it most often does; matches and lengths are added up over the group before
    the geometric mean. A candidate's reference length is that nearest to its own, the smaller of two. `candidates`
    and `references` are these sums of words. A null text is an empty one; a pair with no references (a null or empty array)
    takes no part. Null `by` values are a group; without pairs there are no rows, or one of zeros if `by` is empty.

    A pair is matched within its row. Only pairs whose key comes again are taken apart, as their grams count together.
    """
    named = list(dict.fromkeys([*keys, *by]))
    none = F.array().cast("array<string>")
    split = lambda c: F.coalesce(words(normalise(c)), none)
    taking = pairs.where(F.size(references) > 0)
    texts = taking.select(*named, split(F.col(candidate)).alias("__c"), F.transform(references, split).alias("__r"))
    size = F.size("__c")
    nearest = F.array_min(F.transform("__r", lambda r: F.struct(F.abs(F.size(r) - size).alias("off"), F.size(r).alias("n"))))["n"]
    again, few = settle(taking.groupBy(*named).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*named))
    again = F.broadcast(again) if few else again
    once, shared = meet(texts, again, named, "left_anti"), meet(texts, again, named, "left_semi")
    grams = held_grams(shared, named, longest)
    own = F.col("side") == 0
    most = grams.groupBy(*named, "n", "gram", "side").agg(F.count(F.lit(1)).alias("times"))
    most = most.groupBy(*named, "n", "gram").agg(F.max(F.when(own, F.col("times"))).alias("c"), F.max(F.when(~own, F.col("times"))).alias("r"))
    met = most.where("c is not null").groupBy(*by, "n").agg(F.sum("c").alias("candidates"), F.sum(F.least("c", F.coalesce("r", F.lit(0)))).alias("matched"))
    lengths = shared.select(*by, F.lit(0).alias("n"), size.cast("long").alias("candidates"), nearest.cast("long").alias("matched"))
    counted = row_matches(once.select(*by, size.cast("long").alias("__n"), nearest.cast("long").alias("__o"), "__c", "__r"), [*by, "__n", "__o"], longest)
    total = lambda m, i: F.struct((i + 1).alias("n"), F.greatest(F.col("__n") - i, F.lit(0)).cast("long").alias("candidates"), m.alias("matched"))
    totals = F.concat(F.array(F.struct(F.lit(0).alias("n"), F.col("__n").alias("candidates"), F.col("__o").alias("matched"))), F.transform("__m", total))
    counted = counted.select(*by, F.explode(totals).alias("__l")).select(*by, "__l.*")
    both = met.select(*by, "n", "candidates", "matched").union(lengths).union(counted)
    both = both.groupBy(*by, "n").agg(F.sum("candidates").alias("candidates"), F.sum("matched").alias("matched"))
    value = lambda n, c: F.coalesce(_of(n, c), F.lit(0))
    every, total = F.lit(True), F.lit(0.0)
    for n in range(1, longest + 1):
        every = every & (value(n, "matched") > 0)
        total = total + F.log(value(n, "matched") / value(n, "candidates"))
    words_c, words_r = value(0, "candidates"), value(0, "matched")
    brevity = F.when(words_c > words_r, F.lit(1.0)).otherwise(F.exp(1 - words_r / F.nullif(words_c, F.lit(0))))
    score = F.when(every, brevity * F.exp(total / longest)).otherwise(0.0)
    return both.groupBy(*by).agg(words_c.alias("candidates"), words_r.alias("references"), score.alias("bleu"))


def f_score(matched: Column, candidates: Column, references: Column) -> Column:
    """Harmonic mean of precision and recall; zero without a match."""
    return F.when(matched > 0, 2 * matched / (candidates + references)).otherwise(0.0)


def rouge(pairs: DataFrame, keys: Sequence[str], candidate: str, reference: str) -> DataFrame:
    """(keys, rouge_1, rouge_2): F scores over words and word pairs."""
    matches = gram_matches(pairs, keys, candidate, reference, 2)
    score = f_score(F.col("matched"), F.col("candidates"), F.col("references"))
    scored = matches.withColumn("score", score)
    return scored.groupBy(*keys).agg(_of(1, "score").alias("rouge_1"), _of(2, "score").alias("rouge_2"))


BLOCK = 1 << 14
"""Places of the second list that one set of bits holds; a longer list is worked on block by block."""


def shared_in_order(a: list, b: list, block: int = BLOCK) -> int:
    """Length of the longest common subsequence, a place of `b` being one bit.

    The bits of `b` that are still set are those where the table of lengths doesn't rise. An entry
    of `a` changes all of them by one addition, whose carries run over the places (Hyyrö, 2004).
    Of each entry only its carry goes from one block of `b` to the next, so memory is bounded by
    the lists and a block's masks. None equals nothing.
    """
    carries = bytearray(len(a))
    found = 0
    for begin in range(0, len(b), block):
        part = b[begin : begin + block]
        masks: dict = {}
        for k, entry in enumerate(part):
            masks[entry] = masks.get(entry, 0) | 1 << k
        masks.pop(None, None)
        size, flat = len(part), (1 << len(part)) - 1
        full = flat
        for k, entry in enumerate(a):
            mask = masks.get(entry, 0)
            if mask or carries[k]:
                met = flat & mask
                moved = flat + met + carries[k]
                carries[k] = moved >> size
                flat = (moved & full) | (flat ^ met)
        found += size - flat.bit_count()
    return found


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays; 0 for a null array, and a null entry equals nothing.

    No built-in function keeps such a table; rows go over in Arrow batches and each takes about len(a) * len(b) / 64 steps.
    """

    def lengths(left: pa.Array, right: pa.Array) -> pa.Array:
        found = (shared_in_order(x.as_py() or [], y.as_py() or []) for x, y in zip(left, right, strict=True))
        return pa.array(found, type=pa.int32())

    return F.arrow_udf(lengths, "int")(a, b)


def rouge_l(candidate: Column, reference: Column) -> Column:
    """F score over the longest common subsequence of words; zero for null or blank texts."""
    none = F.array().cast("array<string>")
    a, b = (F.coalesce(words(normalise(c)), none) for c in (candidate, reference))
    return f_score(common_length(a, b), F.size(a), F.size(b))
