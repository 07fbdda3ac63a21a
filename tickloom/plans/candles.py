"""Candles and daily summaries; both aggregate map-side before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.validate import valid_ticks
from ..schema import TICK_ORDER


def _ohlc() -> list[Column]:
    placed = F.struct(*TICK_ORDER)
    return [
        F.min_by("price", placed).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", placed).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("ticks"),
    ]


def candles(ticks: DataFrame, width: str = "1h", late: str | None = None) -> DataFrame:
    """Open, high, low, close, volume and tick count per ticker and time bucket.

    On a stream ``late`` is the watermark, and a bucket is emitted once, when it has closed.
    """
    bucket = F.window("ts", f"{int(C.duration(width).total_seconds())} seconds")
    rows = valid_ticks(ticks)
    if late is not None:
        rows = rows.withWatermark("ts", f"{int(C.duration(late).total_seconds())} seconds")
    return (
        rows.groupBy("ticker", bucket)
        .agg(*_ohlc())
        .select("ticker", F.col("window.start").alias("bucket"), "open", "high", "low", "close", "volume", "ticks")
    )


def daily_summary(ticks: DataFrame) -> DataFrame:
    """Per ticker and day: candle, VWAP, change from open, change from the day before, and range."""
    price, high, low, volume = (F.col(name) for name in ("price", "high", "low", "volume"))
    counted = C.counts_for_vwap(price, high, low, volume)
    days = (
        valid_ticks(ticks)
        .withColumns(
            {
                "dt": C.utc_date(F.col("ts")),
                "_money": F.when(counted, C.typical_price(price, high, low) * volume).otherwise(0.0),
                "_volume": F.when(counted, volume.cast("double")).otherwise(0.0),
            }
        )
        .groupBy("ticker", "dt")
        .agg(*_ohlc(), F.coalesce(F.try_divide(F.sum("_money"), F.sum("_volume")), F.lit(0.0)).alias("vwap"))
    )
    # One row per day by now, so a ticker's window holds its days and not its ticks.
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("dt"))
    return days.select(
        "*",
        C.percent_change(F.col("open"), F.col("close")).alias("change_pct"),
        C.percent_change(before, F.col("close")).alias("day_change_pct"),
        (F.try_divide(F.col("high") - F.col("low"), F.col("low")) * 100.0).alias("range_pct"),
    )
