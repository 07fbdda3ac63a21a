"""Indicator state of one ticker, advanced over an array of prices.

Used where state crosses a boundary: between micro-batches of a stream, and between the
pieces of a split ticker. Everything else is done with window functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd


@dataclass(frozen=True)
class IndicatorSpec:
    """Which indicators to compute.

    ``rsi_seed="zero"`` starts the smoothing from zero at change number ``period``;
    ``"wilder"`` starts it from the mean of the first ``period`` changes.
    ``reset_by`` names columns whose change resets every indicator (a session date, say).
    """

    sma: tuple[int, ...] = (20, 50)
    rsi: tuple[int, ...] = (14,)
    vwap: bool = True
    rsi_seed: str = "zero"
    reset_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if any(period < 1 for period in self.sma + self.rsi):
            raise ValueError("an indicator period must be greater than zero")
        if self.rsi_seed not in ("zero", "wilder"):
            raise ValueError(f"unknown rsi_seed {self.rsi_seed!r}")

    @property
    def longest(self) -> int:
        return max(self.sma + self.rsi + (1,))


DEFAULT_SPEC = IndicatorSpec()


@dataclass
class Smoothed:
    """Running averages of one RSI period and the last value they gave."""

    avg_gain: float = 0.0
    avg_loss: float = 0.0
    value: float = 100.0
    seed_gain: float = 0.0
    seed_loss: float = 0.0

    def as_list(self) -> list[float]:
        return [self.avg_gain, self.avg_loss, self.value, self.seed_gain, self.seed_loss]


@dataclass
class TickerState:
    seen: int = 0
    tail: list[float] = field(default_factory=list)
    money: float = 0.0
    volume: float = 0.0
    smoothed: dict[int, Smoothed] = field(default_factory=dict)

    @classmethod
    def start(cls, spec: IndicatorSpec) -> TickerState:
        return cls(smoothed={period: Smoothed() for period in spec.rsi})


def rsi_values(avg_gain: np.ndarray, avg_loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.where(avg_loss == 0, 100.0, 100.0 - 100.0 / (1.0 + avg_gain / avg_loss))


def advance(state: TickerState, prices: np.ndarray, spec: IndicatorSpec) -> dict[str, np.ndarray]:
    """Apply prices in order; returns one array per moving average and RSI, and updates ``state``."""
    size = len(prices)
    out: dict[str, np.ndarray] = {}
    if size == 0:
        return {f"sma_{p}": np.empty(0) for p in spec.sma} | {f"rsi_{p}": np.empty(0) for p in spec.rsi}

    held = np.asarray(state.tail, dtype=float)
    joined = np.concatenate([held, prices])
    for period in spec.sma:
        values = np.zeros(len(joined))
        if len(joined) >= period:
            values[period - 1 :] = np.lib.stride_tricks.sliding_window_view(joined, period).mean(axis=1)
        out[f"sma_{period}"] = values[len(held) :]

    previous = held[-1] if len(held) else prices[0]
    change = np.diff(np.concatenate([[previous], prices]))
    number = state.seen + np.arange(size)
    for period, smoothed in state.smoothed.items():
        gain, loss = np.maximum(change, 0.0), np.maximum(-change, 0.0)
        early = number < period
        if spec.rsi_seed == "wilder":
            smoothed.seed_gain += float(gain[early].sum())
            smoothed.seed_loss += float(loss[early].sum())
            gain[number == period] += smoothed.seed_gain
            loss[number == period] += smoothed.seed_loss
        gain[early], loss[early] = 0.0, 0.0
        avg_gain = pd.Series(np.concatenate([[smoothed.avg_gain], gain])).ewm(alpha=1 / period, adjust=False).mean()
        avg_loss = pd.Series(np.concatenate([[smoothed.avg_loss], loss])).ewm(alpha=1 / period, adjust=False).mean()
        avg_gain, avg_loss = avg_gain.to_numpy()[1:], avg_loss.to_numpy()[1:]
        # An unchanged price scales both averages alike, so the index keeps its last value. (With a
        # period of one the averages have no memory, and an unchanged price gives 100.)
        moved = (gain > 0) | (loss > 0) | (~early & (period == 1))
        values = pd.Series(np.where(moved, rsi_values(avg_gain, avg_loss), np.nan)).ffill().fillna(smoothed.value)
        smoothed.avg_gain, smoothed.avg_loss = float(avg_gain[-1]), float(avg_loss[-1])
        smoothed.value = float(values.iloc[-1])
        out[f"rsi_{period}"] = np.where(early, 0.0, values.to_numpy())

    state.seen += size
    state.tail = joined[-spec.longest :].tolist()
    return out
