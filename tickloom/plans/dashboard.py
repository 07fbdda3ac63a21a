"""The five time-series questions, over stored points.

``as_of`` is the instant "now" (default: the current time). A range includes its start and
excludes its end. Where the table has its ``dt`` partition column the range prunes by it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import INDICATOR_FIELDS, TICK_ORDER


def just_after_latest(points: DataFrame) -> Column:
    """An ``as_of`` that includes the newest point."""
    newest = points.agg(F.max(F.unix_micros("ts"))).first()[0]
    return F.timestamp_micros(F.lit(0 if newest is None else newest + 1).cast("long"))


def within(points: DataFrame, range_: str, as_of: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if as_of is None else as_of
    # In microseconds: a day of the session's zone may be longer or shorter than 24 hours.
    micros = int(C.duration(range_).total_seconds() * 1_000_000)
    start = F.timestamp_micros(F.unix_micros(now) - F.lit(micros))
    if "dt" in points.columns:
        points = points.where((F.col("dt") >= C.utc_date(start)) & (F.col("dt") <= C.utc_date(now)))
    return points.where((F.col("ts") >= start) & (F.col("ts") < now))


def _placed() -> Column:
    return F.struct(*TICK_ORDER)


def latest_tick(points: DataFrame, ticker: str, as_of: Column | None = None) -> DataFrame:
    """The newest point of one ticker in the last hour; no row if there is none."""
    rows = within(points.where(F.col("ticker") == ticker), "1h", as_of)
    names = [name for name in points.columns if name not in ("ticker", "dt")]
    newest = F.max_by(F.struct(*names), _placed()).alias("newest")
    return rows.groupBy("ticker").agg(newest).select("ticker", "newest.*")


def price_history(points: DataFrame, ticker: str, range_: str = "1h", as_of: Column | None = None) -> DataFrame:
    rows = within(points.where(F.col("ticker") == ticker), range_, as_of)
    return rows.orderBy(*TICK_ORDER).select("ts", "seq", "price")


def indicator_history(points: DataFrame, ticker: str, range_: str = "1h", as_of: Column | None = None) -> DataFrame:
    """Points that carry indicators, oldest first."""
    rows = within(points.where(F.col("ticker") == ticker), range_, as_of)
    return (
        rows.where(F.coalesce(*[F.col(name) for name in INDICATOR_FIELDS]).isNotNull())
        .orderBy(*TICK_ORDER)
        .select("ts", "seq", *INDICATOR_FIELDS)
    )


def first_and_last(points: DataFrame, per_source: bool = False) -> DataFrame:
    """First and last price of each series in one aggregation, in place of two scans and a join."""
    series = ["ticker", "source"] if per_source else ["ticker"]
    return points.groupBy(*series).agg(
        F.min_by("price", _placed()).alias("first_price"), F.max_by("price", _placed()).alias("last_price")
    )


def top_movers(
    points: DataFrame,
    top_n: int = 10,
    range_: str = "1h",
    as_of: Column | None = None,
    by: str = "signed",
    per_source: bool = False,
) -> DataFrame:
    """The ``top_n`` largest price changes, in percent of the first price.

    ``by="signed"`` ranks the rise, ``by="abs"`` the size of the change.
    """
    if by not in ("signed", "abs"):
        raise ValueError(f"unknown ranking {by!r}")
    moved = first_and_last(within(points, range_, as_of), per_source)
    moved = moved.withColumn("change_pct", C.percent_change(F.col("first_price"), F.col("last_price")))
    rank = F.abs("change_pct") if by == "abs" else F.col("change_pct")
    ties = [name for name in ("ticker", "source") if name in moved.columns]
    return moved.orderBy(F.desc_nulls_last(rank), *ties).limit(top_n)


def market_summary(points: DataFrame, as_of: Column | None = None, range_: str = "1h", per_source: bool = False) -> DataFrame:
    """The latest price of every ticker in the last hour, by ticker."""
    series = ["ticker", "source"] if per_source else ["ticker"]
    rows = within(points, range_, as_of)
    latest = rows.groupBy(*series).agg(F.max_by("price", _placed()).alias("price"), F.max("ts").alias("ts"))
    return latest.orderBy(*series)
