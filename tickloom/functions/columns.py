"""Scalar column functions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = re.compile(r"^\s*(\d+)\s*([smhdw])\s*$")
_UNIT = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def duration(text: str) -> timedelta:
    """``"1h"``, ``"24h"``, ``"7d"`` and the like; units s, m, h, d, w."""
    match = _DURATION.match(text)
    if match is None or int(match.group(1)) == 0:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(**{_UNIT[match.group(2)]: int(match.group(1))})


def utc_date(ts: Column) -> Column:
    """The day in UTC, whatever the time zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / F.lit(86_400)).cast("int"))


def iso_text(ts: Column) -> Column:
    """UTC text with whole seconds, such as 2024-01-15T14:30:00Z, whatever the time zone of the session."""
    second = F.pmod(F.unix_seconds(ts), F.lit(86_400))
    parts = (F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.concat(utc_date(ts).cast("string"), F.lit("T"), F.format_string("%02d:%02d:%02d", *parts), F.lit("Z"))


def iso_timestamp(text: Column) -> Column:
    """Inverse of :func:`iso_text`; NULL when the text does not parse."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def is_finite(column: Column) -> Column:
    """False for NaN, infinities and NULL; NaN sorts above every number in Spark."""
    return F.coalesce((column > -float("inf")) & (column < float("inf")), F.lit(False))


def number_or(column: Column, default: float = 0.0) -> Column:
    """The number, or the default where it is missing or not finite."""
    return F.when(is_finite(column), column).otherwise(F.lit(default))


def is_valid_price(price: Column) -> Column:
    """A finite price above zero; NaN sorts above every number in Spark, hence the upper bound."""
    return F.coalesce((price > 0) & (price < float("inf")), F.lit(False))


def typical_price(price: Column, high: Column, low: Column) -> Column:
    return (high + low + price) / F.lit(3.0)


def counts_for_vwap(price: Column, high: Column, low: Column, volume: Column) -> Column:
    prices = is_valid_price(price) & is_valid_price(high) & is_valid_price(low)
    return prices & F.coalesce(volume > 0, F.lit(False))


def percent_change(first: Column, last: Column) -> Column:
    """NULL where the first value is zero."""
    return F.try_divide(last - first, first) * F.lit(100.0)


def gain(change: Column) -> Column:
    return F.greatest(change, F.lit(0.0))


def loss(change: Column) -> Column:
    return F.greatest(-change, F.lit(0.0))


def rsi_of(avg_gain: Column, avg_loss: Column) -> Column:
    """Relative strength index of two averages; 100 when nothing was lost."""
    strength = F.try_divide(avg_gain, avg_loss)
    return F.when(avg_loss == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + strength)
    )


def rsi_signal(rsi: Column, ready: Column, low: float = 30.0, high: float = 70.0) -> Column:
    return F.when(
        ready,
        F.when(rsi > high, F.lit("overbought")).when(rsi < low, F.lit("oversold")).otherwise(F.lit("neutral")),
    )


def vwap_signal(price: Column, vwap: Column, ready: Column, tolerance: float = 0.001) -> Column:
    """Price against VWAP; within ``tolerance`` (a share of VWAP) counts as fair."""
    return F.when(
        ready,
        F.when(price > vwap * (1 + tolerance), F.lit("above"))
        .when(price < vwap * (1 - tolerance), F.lit("below"))
        .otherwise(F.lit("fair")),
    )


def rounded(column: Column, places: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(column, places) + F.lit(0.0)
