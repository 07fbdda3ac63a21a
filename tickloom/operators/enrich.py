"""Ticks with their indicator block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.stepper import DEFAULT_SPEC, IndicatorSpec
from ..schema import INDICATOR_FIELDS
from .indicators import rsi_ready, sma_ready, with_indicators
from .pieces import DEFAULT_SPLIT, HotSplit
from .validate import valid_ticks

READY_AT = 50


def enrich(ticks: DataFrame, rsi_seed: str = "zero", split: HotSplit = DEFAULT_SPLIT) -> DataFrame:
    """One row per valid tick, with ``indicators`` and ``indicators_ready`` (fifty valid ticks seen)."""
    spec = IndicatorSpec(rsi_seed=rsi_seed)
    return nest_indicators(with_indicators(valid_ticks(ticks), spec, split))


def nest_indicators(ticks: DataFrame) -> DataFrame:
    spent = {"tick_no", "vwap_ready", *INDICATOR_FIELDS}
    return ticks.select(
        *[name for name in ticks.columns if name not in spent],
        F.struct(*INDICATOR_FIELDS).alias("indicators"),
        sma_ready(READY_AT).alias("indicators_ready"),
    )


def with_signals(ticks: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Overbought / oversold and above / below VWAP labels; NULL until the indicator is ready."""
    known = with_indicators(valid_ticks(ticks), DEFAULT_SPEC)
    return known.withColumns(
        {
            "rsi_signal": C.rsi_signal(F.col("rsi_14"), rsi_ready(14)),
            "vwap_signal": C.vwap_signal(F.col("price"), F.col("vwap"), F.col("vwap_ready"), tolerance),
        }
    )


def session_vwap(ticks: DataFrame, split: HotSplit = DEFAULT_SPLIT) -> DataFrame:
    """VWAP that starts anew each UTC day."""
    spec = IndicatorSpec(sma=(), rsi=(), reset_by=("session",))
    return with_indicators(valid_ticks(ticks).withColumn("session", C.utc_date(F.col("ts"))), spec, split)
