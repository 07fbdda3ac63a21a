"""The newest ticks of each ticker, kept over a stream, and how many older ones they pushed out."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import TICK_ORDER
from .ordered import require_rocksdb

#: A task hands on what it holds once it holds so many ticks.
_HELD_ROWS = 500_000


def newest_stream(ticks: DataFrame, n: int) -> DataFrame:
    """After each micro-batch the newest ``n`` ticks of the tickers in it, with ``seen`` and ``overwritten``.

    ``seen`` counts the ticks of the ticker so far, so the rows with its largest value are what is kept now
    (:func:`kept_now`). Each task first cuts its part of a micro-batch to ``n`` ticks a ticker and counts the rest, so
    a hot ticker brings at most ``n`` rows a task to its state. Ticks without a ticker are left out; of ticks equal in
    (ts, seq) any may stay, and a tick without a time is the oldest. Nulls in other columns and repeated ticks are
    kept as they are. The session must use the RocksDB state store.
    """
    if n < 1:
        raise ValueError(f"at least one tick is kept, not {n}")
    require_rocksdb(ticks.sparkSession)
    rows = ticks.where(F.col("ticker").isNotNull())
    names = rows.columns
    cut = T.StructType([*rows.schema.fields, T.StructField("tick_count", T.LongType())])
    output = T.StructType([*rows.schema.fields, T.StructField("seen", T.LongType()), T.StructField("overwritten", T.LongType())])
    fewer = rows.mapInPandas(lambda frames: _newest_of_task(frames, n), cut)
    return fewer.groupBy("ticker").transformWithStateInPandas(_Newest(n, names), output, "Append", "none")


def kept_now(retained: DataFrame) -> DataFrame:
    """What :func:`newest_stream` put out last for each ticker."""
    last = F.max("seen").over(Window.partitionBy("ticker"))
    return retained.withColumn("_last", last).where(F.col("seen") == F.col("_last")).drop("_last")


def _newest_of_task(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    held, seen, size = [], Counter(), 0
    for frame in frames:
        seen.update(frame["ticker"].value_counts().to_dict())
        held.append(frame)
        size += len(frame)
        if size > _HELD_ROWS:
            held = [_newest(pd.concat(held, ignore_index=True), n)]
            size = len(held[0])
            if size > _HELD_ROWS // 2:
                yield _counted(held[0], seen)
                held, seen, size = [], Counter(), 0
    if held:
        yield _counted(_newest(pd.concat(held, ignore_index=True), n), seen)


def _newest(ticks: pd.DataFrame, n: int) -> pd.DataFrame:
    ordered = ticks.sort_values(list(TICK_ORDER), kind="stable", na_position="first")
    return ordered.groupby("ticker", sort=False).tail(n)


def _counted(kept: pd.DataFrame, seen: Counter) -> pd.DataFrame:
    """The count of all ticks of a ticker stands at the first one kept."""
    first = ~kept["ticker"].duplicated()
    return kept.assign(tick_count=kept["ticker"].map(seen).where(first, 0).astype("int64"))


class _Newest(StatefulProcessor):
    """State of a ticker: its newest ticks and how many it has had."""

    def __init__(self, n: int, names: list[str]) -> None:
        self.n, self.names = n, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "ticks BINARY, seen BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held, seen = None, 0
        if self.kept.exists():
            stored, seen = self.kept.get()
            held = pa.ipc.open_stream(stored).read_all().to_pandas()
        for frame in rows:
            seen += int(frame["tick_count"].sum())
            frame = frame[self.names]
            held = _newest(frame if held is None else pd.concat([held, frame], ignore_index=True), self.n)
        table = pa.Table.from_pandas(held, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.kept.update((sink.getvalue().to_pybytes(), seen))
        yield held.assign(seen=seen, overwritten=seen - len(held))

    def close(self) -> None:
        pass
