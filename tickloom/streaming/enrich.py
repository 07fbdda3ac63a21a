"""Indicators over a stream, with one checkpointed state per ticker."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import columns as C
from ..functions.stepper import IndicatorSpec, Smoothed, TickerState, advance
from ..operators.enrich import nest_indicators
from ..operators.validate import valid_ticks
from ..schema import INDICATOR_FIELDS, TICK_ORDER

_STATE = "seen BIGINT, money DOUBLE, volume DOUBLE, tail ARRAY<DOUBLE>, smoothed ARRAY<DOUBLE>"
_WIDTH = len(Smoothed().as_list())


def enrich_stream(ticks: DataFrame, rsi_seed: str = "zero") -> DataFrame:
    """The streaming twin of :func:`operators.enrich.enrich`: one output row per valid tick.

    Ticks of a ticker are applied in order inside a micro-batch and as they arrive across them; how
    many a micro-batch holds is bounded at the source. State holds fifty prices and a few sums, and
    is kept for ever.
    """
    spec = IndicatorSpec(rsi_seed=rsi_seed)
    rows = valid_ticks(ticks)
    added = [T.StructField("tick_no", T.LongType())]
    added += [T.StructField(name, T.DoubleType()) for name in INDICATOR_FIELDS]
    added.append(T.StructField("vwap_ready", T.BooleanType()))
    output = T.StructType([*rows.schema.fields, *added])

    def step(key: tuple, frames: Iterable[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = _load(group.get, spec) if group.exists else TickerState.start(spec)
        batch = pd.concat(list(frames), ignore_index=True).sort_values(list(TICK_ORDER), ignore_index=True)
        yield _advance_frame(state, batch, spec)[output.fieldNames()]
        group.update(_store(state))

    enriched = rows.groupBy("ticker").applyInPandasWithState(
        step, output, _STATE, "append", GroupStateTimeout.NoTimeout
    )
    return nest_indicators(enriched)


def _advance_frame(state: TickerState, batch: pd.DataFrame, spec: IndicatorSpec) -> pd.DataFrame:
    batch["tick_no"] = state.seen + 1 + np.arange(len(batch))
    batch = batch.assign(**advance(state, batch["price"].to_numpy(dtype=float), spec))
    price, high, low = (batch[name].to_numpy(dtype=float) for name in ("price", "high", "low"))
    volume = batch["volume"].to_numpy(dtype=float)
    counted = (volume > 0) & (price > 0) & (high > 0) & (low > 0)
    money = state.money + np.cumsum(np.where(counted, (high + low + price) / 3.0 * volume, 0.0))
    total = state.volume + np.cumsum(np.where(counted, volume, 0.0))
    batch["vwap_ready"] = total > 0
    batch["vwap"] = np.divide(money, total, out=np.zeros(len(batch)), where=total > 0)
    state.money, state.volume = float(money[-1]), float(total[-1])
    return batch


def _load(stored: tuple, spec: IndicatorSpec) -> TickerState:
    seen, money, volume, tail, flat = stored
    smoothed = {p: Smoothed(*flat[i * _WIDTH : (i + 1) * _WIDTH]) for i, p in enumerate(spec.rsi)}
    return TickerState(seen, list(tail), money, volume, smoothed)


def _store(state: TickerState) -> tuple:
    flat = [value for smoothed in state.smoothed.values() for value in smoothed.as_list()]
    return (state.seen, state.money, state.volume, state.tail, flat)


def counted_stream(ticks: DataFrame) -> DataFrame:
    """The stream with the counters of :mod:`streaming.health` attached."""
    valid = F.col("ticker").isNotNull() & C.is_valid_price(F.col("price"))
    return ticks.observe(
        "health",
        F.count(F.lit(1)).alias("ticks"),
        F.count(F.when(valid, 1)).alias("valid"),
        F.approx_count_distinct("ticker").alias("tickers"),
    )
