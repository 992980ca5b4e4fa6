"""Packing by power-of-two decomposition.

The ids of a document and its closing id are cut, from the left, into pieces of `longest`
(a power of two) ids as long as they last and then into the binary parts of the rest, largest
first. A piece is a sequence of its own: no sequence crosses documents, and none is padded,
as each length is a power of two. Sequences of one length make up a bucket, so a training
batch is drawn from one bucket.

Cutting needs nothing but the document, so no row is shuffled and a source or a length that
holds most rows costs nothing extra. A sequence's number is made of its bucket, the number of
the task that read the document and a running number there; a task that is run again reads the
same rows and gives the same numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import load_bpe
from millrace.llm.common import text_slices

LONGEST = 2048
TASK_BITS, RUN_BITS = 24, 34
"""Bits of a sequence number for the task and for the running number; the bucket's five stand above."""


def binary_lengths(total: int, longest: int = LONGEST) -> list[int]:
    """The lengths of the pieces of a document of `total` ids."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", closing_id: int = 1, longest: int = LONGEST, with_ids: bool = True
) -> DataFrame:
    """Encode, close and cut every document: one row per piece.

    Columns: doc_id, start (ids of its document before it), length, bucket (log2 of the
    length), ids (array, when `with_ids`), ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens (with the closing id), sequence_id, offset (0: a piece fills its sequence).
    A null or empty text is one piece, the closing id. Repeated rows are packed each; a
    null id is carried as it is. Other columns of `df` are not read.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    rows = df.select(df[doc_id].alias("doc_id"), df[text].alias("__text"))
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = load_bpe(path), TaskContext.get().partitionId()
        if task >> TASK_BITS:
            raise ValueError("too many partitions for sequence numbers")
        used = [0] * longest.bit_length()
        for batch, texts in text_slices(batches):
            flat, ends = bpe.encode(texts)
            sizes = np.diff(ends) + 1
            flat = np.insert(flat, ends[1:], closing_id).astype("<u4")
            per_doc = [binary_lengths(n, longest) for n in sizes.tolist()]
            lengths = np.fromiter((x for pieces in per_doc for x in pieces), dtype=np.int64)
            counts = np.fromiter(map(len, per_doc), dtype=np.int64, count=len(per_doc))
            at = np.cumsum(lengths) - lengths
            docs = np.repeat(np.arange(len(per_doc)), counts)
            raw = memoryview(flat.tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), lengths.tolist(), strict=True)]
            numbers, buckets = [], [n.bit_length() - 1 for n in lengths.tolist()]
            for k in buckets:
                numbers.append((k << TASK_BITS | task) << RUN_BITS | used[k])
                used[k] += 1
            columns = [
                batch.column(0).take(pa.array(docs)), pa.array(at - (np.cumsum(sizes) - sizes)[docs]), pa.array(lengths), pa.array(buckets, type=pa.int32()),
                pa.array(crcs, type=pa.int64()), pa.array(sizes[docs]), pa.array(numbers, type=pa.int64()), pa.array(np.zeros(len(docs), dtype=np.int64)),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), type=pa.int32()), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, start long, length long, bucket int, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def write_buckets(packed: DataFrame, folder: str) -> None:
    """One folder per bucket, as `bucket=11/` for sequences of 2,048 ids."""
    packed.write.partitionBy("bucket").parquet(folder)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ids without the closing one) for every document whose pieces carry ids."""
    pieces = F.array_sort(F.collect_list(F.struct("start", "ids")))
    whole = F.flatten(F.transform(pieces, lambda p: p["ids"]))
    return packed.groupBy("doc_id").agg(whole.alias("ids")).select("doc_id", F.slice("ids", 1, F.size("ids") - 1).alias("ids"))
