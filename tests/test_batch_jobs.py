from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest

from tickloom.operators.pieces import HotSplit
from tickloom.plans.backtest import Crossover, RsiBand, backtest
from tickloom.plans.candles import candles, daily_summary
from tickloom.plans.correlation import candle_returns, correlation

from .conftest import START
from .test_indicators import fold


def walk(n, names, seed=5):
    rng, level, pairs = random.Random(seed), {name: 100.0 for name in names}, []
    for _ in range(n):
        name = rng.choice(names)
        level[name] *= math.exp(rng.gauss(0, 0.02))
        pairs.append((name, level[name]))
    return pairs


def test_candles(make_ticks):
    pairs = [("A", 5.0), ("A", 9.0), ("A", 0.0), ("A", 4.0), ("A", 6.0), ("B", 1.0)]
    ticks = make_ticks(pairs, ts=lambda i: START + timedelta(minutes=10 * i), volume=lambda i: i)
    rows = {(r["ticker"], r["bucket"].hour): tuple(r)[2:] for r in candles(ticks, "1h").collect()}
    assert rows == {("A", 14): (5.0, 9.0, 5.0, 9.0, 1, 2), ("A", 15): (4.0, 6.0, 4.0, 6.0, 7, 2), ("B", 15): (1.0, 1.0, 1.0, 1.0, 5, 1)}


def test_daily_summary(make_ticks):
    ticks = make_ticks([("A", 10.0), ("A", 20.0), ("A", 30.0)], ts=lambda i: START + timedelta(hours=8 * i))
    first, second = daily_summary(ticks).orderBy("dt").collect()
    assert (first["open"], first["close"], first["change_pct"], first["day_change_pct"]) == (10.0, 20.0, 100.0, None)
    assert first["vwap"] == pytest.approx(15.0) and first["range_pct"] == pytest.approx(100.0)
    assert second["day_change_pct"] == pytest.approx(50.0)


@pytest.mark.parametrize("per_block,per_task", [(256, 4096), (2, 3)])
def test_correlation(make_ticks, per_block, per_task):
    ticks = make_ticks(walk(600, list("ABCDE")), ts=lambda i: START + timedelta(minutes=i))
    wide = candle_returns(ticks, "10m").toPandas().pivot(index="bucket", columns="ticker", values="ret")
    expected, both = wide.corr(min_periods=2), wide.notna().astype(int)
    rows = correlation(ticks, "10m", per_block, per_task).collect()
    assert len(rows) == 10
    for row in rows:
        a, b = row["ticker_a"], row["ticker_b"]
        assert a < b and row["n"] == int((both[a] * both[b]).sum())
        assert row["corr"] == pytest.approx(expected.loc[a, b], abs=1e-9)
    assert len(correlation(ticks, "10m", per_block, per_task, full=True).collect()) == 20


def test_correlation_of_a_still_ticker_is_null(make_ticks):
    ticks = make_ticks([(name, price) for i in range(9) for name, price in (("A", 5.0), ("B", 1.0 + i % 4))], ts=lambda i: START + timedelta(hours=i // 2))
    assert [(r["n"], r["corr"]) for r in correlation(ticks, "1h").collect()] == [(8, None)]


def brute(prices, rule):
    if isinstance(rule, Crossover):
        mean = lambda i, p: sum(prices[i + 1 - p : i + 1]) / p
        pos = [int(i + 1 >= rule.slow and mean(i, rule.fast) > mean(i, rule.slow)) for i in range(len(prices))]
    else:
        rsi = fold(prices, rule.period)
        pos = [0 if i < rule.period else 1 if v < rule.low else -1 if v > rule.high else 0 for i, v in enumerate(rsi)]
    made = [p * math.log(b / a) for p, a, b in zip(pos, prices, prices[1:])]
    level = top = draw = 0.0
    for m in made:
        level += m
        top = max(top, level)
        draw = max(draw, top - level)
    held = sum(p != 0 for p in pos[:-1])
    won = sum(m > 0 for m in made)
    trades = sum(p != 0 and p != q for p, q in zip(pos, [0, *pos]))
    return trades, held, won / held if held else None, level, draw


@pytest.mark.parametrize("split", [HotSplit(), HotSplit(40)])
def test_backtest_follows_the_rules(make_ticks, split):
    pairs = walk(700, ["A", "B"])
    rules = (Crossover(3, 8), RsiBand(3, 35, 65), RsiBand(14, 1, 99))
    rows = {(r["ticker"], r["rule"]): tuple(r)[2:] for r in backtest(make_ticks(pairs), rules, split).collect()}
    assert len(rows) == 6
    for ticker in "AB":
        prices = [price for name, price in pairs if name == ticker]
        for rule in rules:
            expected = brute(prices, rule)
            assert rows[ticker, rule.name] == tuple(v if v is None else pytest.approx(v, abs=1e-9) for v in expected)


def test_equal_averages_are_not_a_crossover(make_ticks):
    """Prices whose two averages are equal again and again, though not to the last digit in floating point."""
    prices = [0.1, 0.2, 0.3, 0.2] * 150
    row = backtest(make_ticks([("A", p) for p in prices]), (Crossover(4, 8),)).collect()[0]
    assert (row["trades"], row["held"]) == (0, 0)


def test_correlation_of_a_ticker_that_stands_still(spark, make_ticks):
    # B trades in the second half only, where A does not move; their overlap has nothing to correlate.
    pairs, hours = [], []
    for hour in range(40):
        pairs.append(("A", 10.0 + (hour * 7 % 5) / 7 if hour < 20 else 11.3))
        hours.append(hour)
        if hour >= 22:
            pairs.append(("B", 5.0 + (hour * 3 % 7) / 3))
            hours.append(hour)
    ticks = make_ticks(pairs, ts=lambda i: START + timedelta(hours=hours[i]))
    (row,) = correlation(ticks, "1h").collect()
    assert (row["ticker_a"], row["ticker_b"], row["n"], row["corr"]) == ("A", "B", 17, None)
