from __future__ import annotations

import random
from datetime import timedelta

import pytest

from tickloom.operators.enrich import enrich
from tickloom.operators.summary import counted_batch, ticker_summary, vwap_total
from tickloom.sources.ticks import read_events, ticks_from_events

from .conftest import START


def by_ticker(df):
    return {row["ticker"]: row for row in df.collect()}


def test_empty_batch(make_ticks):
    assert ticker_summary(make_ticks([])).collect() == []


def test_counts_and_last_price_per_ticker(make_ticks):
    pairs = []
    for i in range(5):
        pairs += [("AAPL", 180.0 + i), ("TSLA", 250.0 + i), ("GOOGL", 130.0 + i)]
    rows = by_ticker(ticker_summary(make_ticks(pairs, open=None)))
    assert {name: (row["last_price"], row["tick_count"]) for name, row in rows.items()} == {
        "AAPL": (184.0, 5),
        "TSLA": (254.0, 5),
        "GOOGL": (134.0, 5),
    }
    assert not any(row["indicators_ready"] for row in rows.values())


@pytest.mark.parametrize("n,ready", [(10, False), (49, False), (50, True)])
def test_ready_at_fifty(make_ticks, n, ready):
    row = by_ticker(ticker_summary(make_ticks([("AAPL", 180.0 + i) for i in range(n)])))["AAPL"]
    assert (row["indicators_ready"], row["tick_count"]) == (ready, n)


def test_sma_20(make_ticks):
    row = by_ticker(ticker_summary(make_ticks([("AAPL", 100.0)] * 20)))["AAPL"]
    assert row["sma_20"] == pytest.approx(100.0) and row["sma_50"] == 0.0


def test_invalid_ticks_are_counted_but_not_used(make_ticks):
    rows = by_ticker(ticker_summary(make_ticks([("AAPL", 182.0), ("AAPL", 0.0), ("AAPL", 183.0), (None, 100.0), ("ZERO", 0.0)])))
    assert set(rows) == {"AAPL", "ZERO"}
    assert (rows["AAPL"]["tick_count"], rows["AAPL"]["last_price"]) == (3, 183.0)
    zero = rows["ZERO"]
    assert (zero["tick_count"], zero["last_price"], zero["rsi_14"], zero["vwap"], zero["indicators_ready"]) == (1, 0.0, 0.0, 0.0, False)


@pytest.mark.parametrize("seed", range(3))
def test_folded_pieces_equal_the_last_enriched_row(make_ticks, seed):
    """Spans of one tick to all of them, silent spans, still prices for longer than a piece, invalid ticks between."""
    rng = random.Random(seed)
    level, pairs, seconds, at = {"A": 50.0, "B": 9.0}, [], [], 0
    for i in range(700):
        ticker = "B" if i % 5 == 0 else "A"
        still = 200 < i < 400 or rng.random() < 0.3
        level[ticker] += 0.0 if still else rng.uniform(-1, 1)
        pairs.append((ticker, 0.0 if rng.random() < 0.05 else round(max(level[ticker], 0.5), 3)))
        at += 500 if rng.random() < 0.02 else rng.randrange(3)
        seconds.append(at)
    pairs += [("ONE", 3.0), ("NONE", -1.0), ("NONE", None)]
    seconds += [at, at, at]
    ticks = make_ticks(pairs, ts=lambda i: START + timedelta(seconds=seconds[i]), volume=lambda i: i % 3)
    last = {}
    for row in enrich(ticks).orderBy("ts", "seq").collect():
        last[row["ticker"]] = row
    for span in ("1s", "40s", "1d"):
        rows = by_ticker(ticker_summary(ticks, span))
        assert set(rows) == {"A", "B", "ONE", "NONE"}
        for ticker, row in last.items():
            assert rows[ticker]["tick_count"] == sum(name == ticker for name, _ in pairs)
            assert (rows[ticker]["last_price"], rows[ticker]["indicators_ready"]) == (row["price"], row["indicators_ready"])
            for name in ("sma_20", "sma_50", "rsi_14", "vwap"):
                assert rows[ticker][name] == pytest.approx(row["indicators"][name], rel=1e-9, abs=1e-9), (span, ticker, name)
        assert (rows["NONE"]["tick_count"], rows["NONE"]["rsi_14"], rows["NONE"]["last_price"]) == (2, 0.0, 0.0)


def test_one_scan_and_one_shuffle_of_ticks(spark):
    ticks = ticks_from_events(read_events(spark, "/root/testdata/sf0.001"))
    plan = ticker_summary(ticks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    before_python = plan[plan.index("MapInPandas") :]
    # Below the states of pieces lies one exchange of ticks; the others carry one row per piece.
    assert before_python.count("Exchange hashpartitioning(ticker") == 3
    assert len([line for line in plan.splitlines() if "Exchange" in line and "_piece" in line and "ENSURE_REQUIREMENTS" in line]) == 1


def test_vwap_total_equals_final_running_vwap(make_ticks):
    ticks = make_ticks([("A", 1.0 + i % 5) for i in range(50)], volume=lambda i: i % 4)
    assert by_ticker(vwap_total(ticks))["A"]["vwap"] == pytest.approx(by_ticker(ticker_summary(ticks))["A"]["vwap"])


def test_counters_come_with_the_pass(make_ticks):
    observed, observation = counted_batch(make_ticks([("A", 1.0), (None, 2.0), ("A", 0.0)]))
    assert observed.count() == 3
    assert observation.get == {"ticks": 3, "ticks_with_ticker": 2, "ticks_valid": 1}
