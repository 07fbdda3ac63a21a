"""Bounded takes from the old or the new end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TICK_ORDER

_FIRST_LEVEL = 256


def oldest_n(ticks: DataFrame, n: int = 500) -> DataFrame:
    return ticks.orderBy(*TICK_ORDER).limit(n)


def newest_n(ticks: DataFrame, n: int, per_ticker: bool = True) -> DataFrame:
    """The newest ``n`` ticks of each ticker, or of all.

    Per ticker in two steps: each task keeps its own newest ``n``, groups of tasks are cut to ``n``,
    then the ticker. A hot ticker therefore brings at most ``256 * n`` rows to the last step.
    """
    newest = [F.desc(name) for name in TICK_ORDER]
    if not per_ticker:
        return ticks.orderBy(*newest).limit(n)
    grouped = ticks.withColumn("_group", F.spark_partition_id() % _FIRST_LEVEL)
    for by in (["ticker", "_group"], ["ticker"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
        grouped = grouped.withColumn("_place", place).where(F.col("_place") <= n)
    return grouped.drop("_group", "_place")


def overwritten(ticks: DataFrame, n: int) -> DataFrame:
    """How many ticks of each ticker a store of ``n`` would have dropped."""
    dropped = F.greatest(F.count(F.lit(1)) - n, F.lit(0).cast("long"))
    return ticks.groupBy("ticker").agg(dropped.alias("overwritten"))
