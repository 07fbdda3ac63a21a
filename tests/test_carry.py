"""Averages carried over many blocks and many pieces."""

from __future__ import annotations

import random

import pytest

from tickloom.functions.stepper import IndicatorSpec
from tickloom.operators.indicators import with_indicators
from tickloom.operators.pieces import HotSplit


def plain_rsi(prices, period, seed):
    """The recurrence itself, row by row."""
    gain = loss = sum_gain = sum_loss = 0.0
    value, out = 100.0, []
    for n, price in enumerate(prices):
        change = price - prices[n - 1] if n else 0.0
        up, down = max(change, 0.0), max(-change, 0.0)
        if n < period:
            sum_gain, sum_loss = sum_gain + up, sum_loss + down
            out.append(0.0)
            continue
        if seed == "wilder" and n == period:
            up, down = up + sum_gain, down + sum_loss
        gain, loss = gain * (period - 1) / period + up / period, loss * (period - 1) / period + down / period
        if up > 0 or down > 0:
            value = 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss)
        out.append(value)
    return out


def rsi_of(spark, make_ticks, prices, period, split, seed="zero"):
    spec = IndicatorSpec(sma=(), rsi=(period,), vwap=False, rsi_seed=seed)
    rows = with_indicators(make_ticks([("A", price) for price in prices]), spec, split).collect()
    return [row[f"rsi_{period}"] for row in sorted(rows, key=lambda row: row["tick_no"])]


@pytest.mark.parametrize("split", [HotSplit(), HotSplit(rows_per_piece=150)])
def test_a_price_scale_that_collapses(spark, make_ticks, split):
    # A huge gain and loss, then small losses for many blocks: the first two outweigh them for hundreds of rows.
    rng = random.Random(1)
    prices = [1e-30, 2e-30, 1e150, 1.0]
    while len(prices) < 700:
        prices.append(prices[-1] * (1 - rng.random() / 50))
    got = rsi_of(spark, make_ticks, prices, 2, split)
    want = plain_rsi(prices, 2, "zero")
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    # 40 rows of period 2 weigh less than a millionth of a millionth, and yet decide the index here.
    assert want[300] == pytest.approx(100 / 3) and want[-1] < 1e-3


@pytest.mark.parametrize("seed", ["zero", "wilder"])
@pytest.mark.parametrize("rows", [1, 3, 40])
def test_pieces_shorter_than_a_period(spark, make_ticks, seed, rows):
    rng = random.Random(rows)
    prices = [100.0]
    for _ in range(90):
        prices.append(prices[-1] if rng.random() < 0.4 else prices[-1] + rng.uniform(-1, 1))
    got = rsi_of(spark, make_ticks, prices, 14, HotSplit(rows_per_piece=rows), seed)
    assert got == pytest.approx(plain_rsi(prices, 14, seed), rel=1e-9)


def test_pieces_are_worked_out_in_parallel(spark, make_ticks):
    ticks = make_ticks([("A", 100.0 + i % 7) for i in range(400)])
    plan = with_indicators(ticks, split=HotSplit(rows_per_piece=50))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInPandas") == 2
