"""Which ticks may be processed or stored, and why the others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import WATCH_LIST

REJECT = "reject_reason"


def tick_reason() -> Column:
    """Reason a tick cannot be processed; NULL for a valid one."""
    return F.when(F.col("ticker").isNull(), F.lit("missing_ticker")).when(
        ~C.is_valid_price(F.col("price")), F.lit("invalid_price")
    )


def with_reason(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn(REJECT, tick_reason())


def valid_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks with a ticker and a price above zero; missing numbers become 0, a missing source 'unknown'."""
    return fill_defaults(ticks.where(F.col("ticker").isNotNull() & C.is_valid_price(F.col("price"))))


def rejected_ticks(ticks: DataFrame) -> DataFrame:
    """The complement of :func:`valid_ticks`, with the reason."""
    return with_reason(ticks).where(F.col(REJECT).isNotNull())


def store_reason() -> Column:
    """Reason a tick cannot be stored; NULL for one that can."""
    return F.when(F.col("ticker").isNull(), F.lit("missing_ticker")).when(
        ~C.is_finite(F.col("price")), F.lit("price_not_finite")
    )


def storable(ticks: DataFrame) -> DataFrame:
    """Ticks that may be stored: a ticker, and a price that is a number, whichever."""
    return ticks.where(store_reason().isNull())


def unstorable(ticks: DataFrame) -> DataFrame:
    """The complement of :func:`storable`, with the reason."""
    return ticks.withColumn(REJECT, store_reason()).where(F.col(REJECT).isNotNull())


def fill_defaults(ticks: DataFrame) -> DataFrame:
    filled = {name: C.number_or(F.col(name)) for name in ("open", "high", "low") if name in ticks.columns}
    filled["volume"] = F.coalesce(F.col("volume"), F.lit(0).cast("long"))
    if "source" in ticks.columns:
        filled["source"] = F.coalesce(F.col("source"), F.lit("unknown"))
    return ticks.withColumns(filled)


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy(REJECT).agg(F.count(F.lit(1)).alias("n"))


def watch_only(ticks: DataFrame, watch: DataFrame | list[str] | tuple[str, ...] = WATCH_LIST) -> DataFrame:
    """Ticks of a watch list, given as symbols or as a relation with a ``ticker`` column."""
    if isinstance(watch, DataFrame):
        return ticks.join(watch.select("ticker"), "ticker", "left_semi")
    return ticks.where(F.col("ticker").isin(list(watch)))
