"""Enriching a stream whose ticks arrive out of order.

Ticks wait, by ticker, until the watermark has passed them; an event-time timer then releases them in the order of
their time into the ticker's indicators, so the values are those of the ordered batch. A tick that the watermark
has passed before it arrives cannot be put in its place any more and comes out at once as a reject. How long ticks
wait, and with it what is held, is bounded by the delay. A ticker that is silent for ``forget_after`` of event time
is forgotten and begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import duration
from ..functions.stepper import IndicatorSpec, TickerState
from ..operators.enrich import nest_indicators
from ..operators.validate import valid_ticks
from ..schema import INDICATOR_FIELDS, TICK_ORDER
from .enrich import _STATE, _advance_frame, _load, _store

#: The reject reason of a tick that came too late.
LATE = "late"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Reorder(StatefulProcessor):
    """State of a ticker: its indicators, the ticks that wait, and when a timer is set."""

    def __init__(self, spec: IndicatorSpec, ticks: T.StructType, output: T.StructType, forget_ms: int | None):
        self.spec, self.names, self.output, self.forget_ms = spec, ticks.fieldNames(), output.fieldNames(), forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _STATE)
        self.waiting = handle.getValueState("waiting", "ticks BINARY")
        self.clock = handle.getValueState("clock", "release BIGINT, latest BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh, latest = [], None
        for frame in rows:
            at = _millis(frame)
            late = at <= watermark
            if late.any():
                yield self._late(frame[late])
            if not late.all():
                fresh.append(frame[~late])
                latest = max(latest or 0, int(at.max()))
        if fresh:
            held = self._waiting()
            self._wait(key, pd.concat([*([] if held is None else [held]), *fresh], ignore_index=True), latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        watermark = timerValues.getCurrentWatermarkInMs()
        if not self.clock.exists():
            return  # forgotten since the timer was set
        held = self._waiting()
        if held is not None:
            due = _millis(held) <= watermark
            if due.any():
                state = _load(self.known.get(), self.spec) if self.known.exists() else TickerState.start(self.spec)
                batch = held[due].sort_values(list(TICK_ORDER), ignore_index=True)
                done = _advance_frame(state, batch, self.spec)
                done["reject_reason"] = None
                self.known.update(_store(state))
                self._wait(key, held[~due], None)
                yield done[self.output]
        _, latest = self.clock.get()
        if self.forget_ms is not None and self._waiting() is None:
            if latest + self.forget_ms <= watermark:
                for state in (self.known, self.waiting, self.clock):
                    state.clear()
            else:
                self.handle.registerTimer(latest + self.forget_ms)

    def close(self) -> None:
        pass

    def _late(self, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(tick_no=0, vwap_ready=False, reject_reason=LATE, **dict.fromkeys(INDICATOR_FIELDS, 0.0))
        return frame[self.output]

    def _waiting(self) -> pd.DataFrame | None:
        if not self.waiting.exists():
            return None
        return pa.ipc.open_stream(self.waiting.get()[0]).read_all().to_pandas()

    def _wait(self, key, held: pd.DataFrame, latest: int | None) -> None:
        """Keep the ticks and have the earliest of them wake the ticker."""
        release, before = self.clock.get() if self.clock.exists() else (None, 0)
        due = None
        if len(held):
            table = pa.Table.from_pandas(held[self.names], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.waiting.update((sink.getvalue().to_pybytes(),))
            # A timer fires once the watermark has passed it.
            due = int(_millis(held).min())
            if due != release:
                self.handle.registerTimer(due)
        else:
            self.waiting.clear()
        self.clock.update((due, max(before, latest or 0)))


def _millis(frame: pd.DataFrame) -> np.ndarray:
    """Times in whole milliseconds, rounded up, as the watermark counts them."""
    return -(-frame["ts"].to_numpy(dtype="datetime64[us]").astype(np.int64) // 1000)


def enrich_ordered(
    ticks: DataFrame, delay: str = "10m", rsi_seed: str = "zero", forget_after: str | None = None
) -> DataFrame:
    """Every valid tick with its indicators, and those that came more than ``delay`` late with ``reject_reason``.

    The session must use the RocksDB state store; see :func:`use_rocksdb`.
    """
    require_rocksdb(ticks.sparkSession)
    rows = valid_ticks(ticks).where(F.col("ts").isNotNull())
    added = [T.StructField("tick_no", T.LongType())]
    added += [T.StructField(name, T.DoubleType()) for name in INDICATOR_FIELDS]
    added += [T.StructField("vwap_ready", T.BooleanType()), T.StructField("reject_reason", T.StringType())]
    output = T.StructType([*rows.schema.fields, *added])
    forget_ms = None if forget_after is None else int(duration(forget_after).total_seconds() * 1000)
    seconds = int(duration(delay).total_seconds())
    # The watermark follows a copy of the time that the operator does not see: Spark would drop late rows itself.
    marked = rows.withColumn("_event", F.col("ts")).withWatermark("_event", f"{seconds} seconds").drop("_event")
    processor = _Reorder(IndicatorSpec(rsi_seed=rsi_seed), rows.schema, output, forget_ms)
    enriched = marked.groupBy("ticker").transformWithStateInPandas(processor, output, "Append", "eventtime")
    return nest_indicators(enriched)


def use_rocksdb(spark: SparkSession) -> str | None:
    """Have streams that this session starts keep their state in RocksDB; returns the provider before."""
    before = spark.conf.get(_PROVIDER, None)
    use_state_store(spark, _ROCKSDB)
    return before


def require_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        raise ValueError("this stream keeps its state in the RocksDB state store: call use_rocksdb first")


def use_state_store(spark: SparkSession, provider: str | None) -> None:
    if provider is None:
        spark.conf.unset(_PROVIDER)
    else:
        spark.conf.set(_PROVIDER, provider)
