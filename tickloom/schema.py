"""Schemas of the tick relations."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields of a normalised tick, of a stored point and of the indicator block.
PRICE_FIELDS = ("price", "open", "high", "low")
INDICATOR_FIELDS = ("sma_20", "sma_50", "rsi_14", "vwap")
POINT_FIELDS = ("price", "open", "high", "low", "volume") + INDICATOR_FIELDS
SOURCE_ONE = "alpha_vantage"
SOURCE_TWO = "massive"
UNKNOWN = "unknown"
WATCH_LIST = ("AAPL", "TSLA", "GOOGL", "MSFT", "AMZN", "META", "NVDA", "AMD", "NFLX", "SHOP")

# Ticks of one ticker are ordered by event time, ties by arrival number.
TICK_ORDER = ("ts", "seq")

RAW_TICK = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
    ]
)

# Payload of a tick message. Volume is decoded as DOUBLE because a writer may send 5.0.
TICK_MESSAGE = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField(
            "indicators",
            T.StructType([T.StructField(name, T.DoubleType()) for name in INDICATOR_FIELDS]),
        ),
        T.StructField("indicators_ready", T.BooleanType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
