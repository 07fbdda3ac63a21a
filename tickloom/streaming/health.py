"""Progress of running streams: rows in, valid rows, tickers, rows in state."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import columns as C
from ..operators.validate import store_reason

COUNTERS = "batch BIGINT, ticks BIGINT, valid BIGINT, points BIGINT, tickers BIGINT"
HEALTH = "query STRING, batch BIGINT, at STRING, ticks BIGINT, valid BIGINT, tickers BIGINT, in_state BIGINT"


def _row(progress: dict) -> tuple:
    counted = progress.get("observedMetrics", {}).get("health") or {}
    in_state = sum(int(op.get("numRowsTotal", 0)) for op in progress.get("stateOperators", []))
    return (
        progress.get("name"),
        int(progress["batchId"]),
        progress["timestamp"],
        int(counted.get("ticks", progress.get("numInputRows", 0))),
        int(counted.get("valid", 0)),
        int(counted.get("tickers", 0)),
        in_state,
    )


def health_report(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per recent micro-batch of a stream built on ``counted_stream``."""
    rows = [_row(json.loads(progress.json)) for progress in query.recentProgress]
    return spark.createDataFrame(rows, HEALTH)


def write_counters(batch: DataFrame, batch_id: int, path: str) -> None:
    """Counters of one micro-batch, kept for good; a repeated batch overwrites its own.

    Unlike the progress that a query keeps in memory, these cover every batch however long the stream runs.
    """
    valid = F.col("ticker").isNotNull() & C.is_valid_price(F.col("price"))
    counters = batch.agg(
        F.count(F.lit(1)).alias("ticks"),
        F.count(F.when(valid, 1)).alias("valid"),
        F.count(F.when(store_reason().isNull(), 1)).alias("points"),
        F.approx_count_distinct("ticker").alias("tickers"),
    )
    counters.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row per micro-batch written by :func:`write_counters`."""
    return spark.read.schema(COUNTERS).parquet(path)


class HealthListener(StreamingQueryListener):
    """Keeps the latest progress rows of all streams; add it with ``spark.streams.addListener``."""

    def __init__(self, keep: int = 1000) -> None:
        self.rows: deque[tuple] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows.append(_row(json.loads(event.progress.json)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
