"""Tick relations from tables, files and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_TICK, SOURCE_ONE, SOURCE_TWO


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Raw ticks from the ``events`` table: ten tickers, with some tickers missing and some prices zero."""
    value, number = F.col("value"), F.col("event_id")
    symbol = F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string"))
    return events.select(
        number.alias("seq"),
        F.when(number % 101 != 0, symbol).alias("ticker"),
        F.when(number % 97 == 0, F.lit(0.0)).otherwise(value).alias("price"),
        value.alias("open"),
        (value * F.lit(1.01)).alias("high"),
        (value * F.lit(0.99)).alias("low"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(number % 2 == 0, F.lit(SOURCE_ONE)).otherwise(F.lit(SOURCE_TWO)).alias("source"),
    )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def read_ticks(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """A landed tick table; JSON files are read with the tick schema, not inferred."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(RAW_TICK)
    return reader.load(path)
