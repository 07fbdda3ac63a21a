"""Stored points: wide with gated indicators, long, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import INDICATOR_FIELDS, POINT_FIELDS, UNKNOWN
from .validate import storable

POINT_KEYS = ("ticker", "source", "ts", "seq")


def to_points(enriched: DataFrame) -> DataFrame:
    """One point per storable tick; indicators stay NULL until ``indicators_ready``, and for plain ticks."""
    known = "indicators" in enriched.columns and "indicators_ready" in enriched.columns
    return storable(enriched).select(
        "ticker",
        F.coalesce("source", F.lit(UNKNOWN)).alias("source"),
        "ts",
        "seq",
        "price",
        *[C.number_or(F.col(name)).alias(name) for name in ("open", "high", "low")],
        F.coalesce("volume", F.lit(0).cast("long")).alias("volume"),
        *[
            (
                F.when(F.col("indicators_ready"), C.number_or(F.col("indicators")[name]))
                if known
                else F.lit(None).cast("double")
            ).alias(name)
            for name in INDICATOR_FIELDS
        ],
    )


def to_long(points: DataFrame, fields: tuple[str, ...] = POINT_FIELDS) -> DataFrame:
    """One row per point and present field: keys, ``field``, ``value``."""
    numeric = points.select(*POINT_KEYS, *[F.col(name).cast("double").alias(name) for name in fields])
    return numeric.unpivot(list(POINT_KEYS), list(fields), "field", "value").where(F.col("value").isNotNull())


def to_wide(long: DataFrame, fields: tuple[str, ...] = POINT_FIELDS) -> DataFrame:
    """Fields as columns again; the field list is fixed, so no extra job looks for it.

    The rows go to their point's partition as they are: a point has each field once, so counting them up beforehand
    would keep every row of a task in a hash table and make none fewer.
    """
    placed = long.repartition(*POINT_KEYS)
    values = [F.first(F.when(F.col("field") == name, F.col("value")), ignorenulls=True).alias(name) for name in fields]
    return placed.groupBy(*POINT_KEYS).agg(*values)
