"""Sessions of a key's events from a stream: state, event-time timers, an account of late rows.

The stream's state is not a session per key, which would put a key with a third
of all events into one task.  Event time is cut into slices and each slice into
lanes, by a hash of key and instant; a lane of a slice is one group of the state
store.  It holds partial sessions of all keys that fall into it (a key, first,
last, number), as one Arrow table.  A timer at the end of the slice gives them
out and clears the state as soon as the watermark has passed, so the store
never holds more than the slices that are still open.

Partial sessions of a key whose spans come within the gap belong to one session;
so the stored output becomes sessions by one pass over it (:func:`stitch`), and
can be stitched again after any later run of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SPAN = ["key", "first_us", "last_us", "n_events"]


def merge_spans(spans: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Spans of a key that overlap or lie within the gap as one, their events added."""
    spans = spans.sort_values(["key", "first_us"], kind="stable")
    reach = spans.groupby("key")["last_us"].cummax()
    before = reach.groupby(spans["key"]).shift()
    number = (before.isna() | (spans["first_us"] - before > gap_us)).cumsum().to_numpy()
    named = spans.groupby(number).agg({"key": "first", "first_us": "min", "last_us": "max", "n_events": "sum"})
    return named.reset_index(drop=True)


class SliceSessions(StatefulProcessor):
    """The partial sessions of a lane of a slice, until the watermark passes the slice's end."""

    def __init__(self, gap_us: int, slice_us: int):
        self.gap_us, self.slice_us = gap_us, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "spans binary")

    def _read(self) -> pd.DataFrame:
        return pa.ipc.open_stream(self.held.get()[0]).read_all().to_pandas()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = [f[~f["closes"].astype(bool)] for f in rows]
        parts = [f.assign(first_us=f["at"], last_us=f["at"], n_events=1)[_SPAN] for f in parts if len(f)]
        if parts:
            if self.held.exists():
                parts.append(self._read())
            else:
                self.handle.registerTimer((int(key[0]) + 1) * self.slice_us // 1000)
            table = pa.Table.from_pandas(merge_spans(pd.concat(parts, ignore_index=True), self.gap_us), preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.held.update((sink.getvalue().to_pybytes(),))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield self._read()
            self.held.clear()

    def close(self) -> None:
        pass


def partial_sessions(
    events: DataFrame, by: Sequence[str], time: str, gap_seconds: int, lateness_seconds: int, slice_seconds: int, lanes: int
) -> DataFrame:
    """``by..., first_us, last_us, n_events`` of a stream of events, each given out once, when its slice is over.

    A boolean column ``_closes``, if there is one, marks rows that carry event
    time on but are no events.  Rows without a time are left out; rows that are
    later than ``lateness_seconds`` are not taken (Spark counts them).
    """
    gap_us, slice_us = gap_seconds * 1_000_000, slice_seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    closes = F.coalesce(F.col("_closes"), F.lit(False)) if "_closes" in events.columns else F.lit(False)
    timed = events.where(F.col(time).isNotNull()).withWatermark(time, f"{lateness_seconds} seconds")
    # names for Python's tuples; keys as text, since a column of whole numbers with nulls becomes one of doubles there
    rows = timed.select(
        F.floor(at / F.lit(slice_us)).alias("slice"),
        F.pmod(F.xxhash64(*by, at), F.lit(lanes)).cast("int").alias("lane"),
        F.to_json(F.struct(*by)).alias("key"), at.alias("at"), closes.alias("closes"), F.col(time).alias("clock"),
    )
    spans = rows.groupBy("slice", "lane").transformWithStateInPandas(
        SliceSessions(gap_us, slice_us), "key string, first_us bigint, last_us bigint, n_events bigint", "Append", "EventTime"
    )
    keys = F.from_json("key", events.select(*by).schema).alias("k")
    return spans.select(keys, *_SPAN[1:]).select(*[F.col("k")[c].alias(c) for c in by], *_SPAN[1:])


def run_sessions(
    spark: SparkSession,
    source: str,
    home: str,
    schema: StructType,
    by: Sequence[str],
    time: str,
    gap_seconds: int,
    lateness_seconds: int,
    slice_seconds: int | None = None,
    lanes: int = 16,
    files_per_batch: int = 1,
) -> DataFrame:
    """Take what has arrived in the folder ``source`` (Parquet); returns ``batch_id, event_rows, late_rows`` of this run.

    ``home``, in the shared folder, keeps the checkpoint and ``partials``, the
    output; another call goes on where the last one ended, also after a loss.
    ``late_rows`` came after the watermark had passed their time: they are in
    no session, and a run that has some can be followed by a batch repair.
    ``lanes`` should be the cluster's cores or more; it stays that of the first
    call with ``home``.
    """
    # the state API needs RocksDB; a partition of the store per lane, since few slices are open at a time
    settings = {_PROVIDER: _ROCKSDB, "spark.sql.shuffle.partitions": str(lanes)}
    previous = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        parts = partial_sessions(stream, by, time, gap_seconds, lateness_seconds, slice_seconds or 16 * gap_seconds, lanes)
        query = (
            parts.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{home}/partials")
            .option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in previous.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # a row a micro-batch, of one run
    late = lambda p: sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
    rows = [(p["batchId"], p["numInputRows"], late(p)) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch_id bigint, event_rows bigint, late_rows bigint")


def stitch(partials: DataFrame, by: Sequence[str], gap_seconds: int) -> DataFrame:
    """``by..., session_start, session_end, n_events``: partial sessions within the gap are one."""
    reach = Window.partitionBy(*by).orderBy("first_us", "last_us").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*by).orderBy("first_us", "last_us").rowsBetween(Window.unboundedPreceding, 0)
    begins: Column = F.coalesce((F.col("first_us") - F.max("last_us").over(reach) > gap_seconds * 1_000_000).cast("long"), F.lit(1))
    numbered = partials.withColumn("_new", begins).withColumn("_session", F.sum("_new").over(order))
    return numbered.groupBy(*by, "_session").agg(
        F.timestamp_micros(F.min("first_us")).alias("session_start"),
        F.timestamp_micros(F.max("last_us")).alias("session_end"),
        F.sum("n_events").alias("n_events"),
    ).drop("_session")
