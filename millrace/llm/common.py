"""What several operators share: folds, bounded Arrow slices, word splitting, hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
"""Text bytes that a task works on at a time; a longer text makes up a slice of its own."""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)), F.lit(0)).cast("int")


def one_label(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """One 0/1 label for each id: the larger if an id has several; null ids and labels are left out."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))


def beside_text(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns to carry, then the text under a name that none of them has."""
    name = "__text"
    while name in keep:
        name += "_"
    return df.select(*keep, df[text].alias(name))


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches, whose last column is a text, into pieces of at most `limit` text bytes: (the rows, their texts with null as '')."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin), texts.slice(begin, end - begin)
            begin = end


@dataclass
class Words:
    """The words of some texts: `codes` points into `distinct`; text i has codes[offsets[i]:offsets[i + 1]]."""

    codes: np.ndarray
    distinct: pa.Array
    offsets: np.ndarray


def words_of(lists: pa.Array) -> Words:
    """From lists of words; empty words are left out."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, offsets = np.asarray(coded.indices, dtype=np.int64), offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))
    if not full.all():
        keep = full[codes]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return Words(codes, coded.dictionary, offsets)


def ascii_words(texts: pa.Array) -> Words:
    """Words between the ASCII white space characters, A-Z lower-cased."""
    return words_of(pc.ascii_split_whitespace(pc.ascii_lower(texts)))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    hashes = (xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist())
    return np.fromiter(hashes, dtype=np.uint64, count=len(distinct))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, gaps: tuple[int, ...]) -> np.ndarray:
    """Hash the words at i and at i + each gap, for every i where all of them exist.

    (1, 2) makes 3-word shingles, (2,) makes skip-grams over one word.
    """
    reach = max(gaps, default=0)
    n = max(0, len(hashes) - reach)
    out = mixed(hashes[:n] + np.uint64(len(gaps) * 1000 + reach + 1))
    for gap in gaps:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[gap : gap + n])
    return out


def in_turn(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
