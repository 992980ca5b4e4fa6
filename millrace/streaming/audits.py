"""What a sliding limiter would say to each request, while requests arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from millrace.operators.rates import verdicts
from millrace.session import ROCKSDB


BUCKETS = 256
"""Groups of keys that a block of time is dealt into. More of them hold fewer requests each, but every one costs calls to the state store."""


class _Content(StatefulProcessor):
    """Keeps the requests of a bucket of keys and a block of time until the watermark has passed the block.

    An entry of the state is a whole Arrow batch, so calls to the store don't grow with requests or keys.
    """

    names = ["who", "id", "at", "tok", "own"]

    def __init__(self, row_id: str, span: int, block: int):
        self.row_id, self.span, self.block = row_id, span, block

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getListState("requests", T.StructType([T.StructField("batch", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            table, out = pa.Table.from_pandas(batch[self.names], preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            self.kept.appendValue((out.getvalue().to_pybytes(),))
        self.handle.registerTimer((int(key[1]) + 1) * self.block // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = pd.concat([pa.ipc.open_stream(bytes(x)).read_pandas() for (x,) in self.kept.get()], ignore_index=True)
        self.kept.clear()
        if rows["own"].any():
            yield self.audited(rows)

    def audited(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The own requests of the rows with what their windows hold."""
        at, tokens, own = (rows[c].to_numpy() for c in ("at", "tok", "own"))
        own = own.astype(bool)
        # (key, time) as one number: the key's place times the number of times, plus the place of the time
        code, times = pd.factorize(rows["who"])[0].astype(np.int64), np.unique(at)
        base = code * (len(times) + 1)
        line = base + np.searchsorted(times, at)
        order = np.argsort(line, kind="stable")
        line, upto = line[order], np.concatenate(([0], np.cumsum(tokens[order])))
        now, base = at[own], base[own]
        begin = np.searchsorted(line, base + np.searchsorted(times, now - self.span, "right"))
        end = np.searchsorted(line, base + np.searchsorted(times, now))
        out = {"who": rows["who"][own].to_numpy(), self.row_id: rows["id"][own].to_numpy(), "__t": now, "__tok": tokens[own]}
        out |= {"in_window": end - begin, "tokens_in_window": upto[end] - upto[begin]}
        return pd.DataFrame(out | {"__oldest": at[order][np.minimum(begin, len(line) - 1)]})

    def close(self) -> None:
        pass


def rate_audit_stream(
    stream: DataFrame, keys: list[str], ts: str, row_id: str, tokens: Column, window_seconds: int = 60, max_requests: int = 50,
    max_tokens: int = 40_000, late: str = "60 seconds", block_seconds: int = 0, buckets: int = BUCKETS,
) -> DataFrame:
    """`rate_audit` over a stream: one row per request once the watermark has passed its block of time.

    A request goes to its own block and, as history, to those that its window reaches into, so a
    key's requests are spread over blocks. Keys are dealt into `buckets` by their hash; a task holds, of
    one bucket, one block (`block_seconds`, a window by default) and the window before it. The state
    of a block ends with it. A query that is started again needs the `buckets` it began with. Rows without an id only
    move the watermark: a source sends one to close what is open. Rows with an id but without a time
    are not given out; a null key is a key like any other, missing tokens count as none. Returns the
    keys, the id, and what `rate_audit` adds.

    State with timers needs the RocksDB store, so the session is set to it for the queries it starts
    from now on; a query started again from its folder keeps the store it began with.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    span = window_seconds * 1_000_000
    block = (block_seconds or window_seconds) * 1_000_000
    at = F.unix_micros(ts)
    seen = stream.withWatermark(ts, late)
    own = F.floor(at / block).cast("long")
    blocks = F.sequence(own, F.floor((at + (span - 1)) / block).cast("long"))
    # not a filter: a filter on the id alone would be pushed below the watermark
    reach = F.when(F.col(row_id).isNotNull() & F.col(ts).isNotNull(), blocks).otherwise(F.array().cast("array<bigint>"))
    who = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    dealt = seen.select(who.alias("who"), F.col(row_id).alias("id"), ts, at.alias("at"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("tok"), own.alias("first"), F.explode(reach).alias("block"))
    dealt = dealt.withColumn("own", F.col("block") == F.col("first")).drop("first").withColumn("bucket", F.pmod(F.xxhash64("who"), F.lit(buckets)))
    kept = stream.schema[row_id]
    schema = T.StructType([T.StructField("who", T.StringType()), kept] + [T.StructField(n, T.LongType()) for n in ("__t", "__tok", "in_window", "tokens_in_window", "__oldest")])
    found = dealt.groupBy("bucket", "block").transformWithStateInPandas(_Content(row_id, span, block), schema, "append", "eventTime")
    named = F.from_json("who", T.StructType([stream.schema[k] for k in keys]))
    added = ["in_window", "tokens_in_window", "rpm_hit", "tpm_hit", "wait_s", "no_history"]
    return verdicts(found, span, max_requests, max_tokens).select(*[named[k].alias(k) for k in keys], row_id, *added)
