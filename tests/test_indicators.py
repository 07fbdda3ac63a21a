from __future__ import annotations

import random
from datetime import timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.functions.stepper import IndicatorSpec, TickerState, advance
from tickloom.operators.enrich import enrich, session_vwap, with_signals
from tickloom.operators.indicators import with_indicators
from tickloom.operators.pieces import HotSplit
from tickloom.operators.validate import valid_ticks

from .conftest import START

MIXED = [50, 51, 49, 52, 55, 54, 53, 57, 58, 56, 60, 59, 61, 63, 62, 60, 64, 66, 65, 67, 70, 68]
# Prices, then RSI(14) at the 15th and the last price for both seeds.
RSI_GOLDEN = [
    ([100.0 + i for i in range(20)], 100.0, 100.0, 100.0, 100.0),
    ([200.0 - i for i in range(20)], 0.0, 0.0, 0.0, 0.0),
    ([100.0 if i % 2 == 0 else 101.0 for i in range(30)], 0.0, 51.851852, 50.0, 52.461159),
    ([float(p) for p in MIXED], 0.0, 65.184519, 71.428571, 70.026263),
    ([100.0 + i % 10 for i in range(60)], 100.0, 60.098225, 59.090909, 59.996469),
    ([100.0] * 20, 100.0, 100.0, 100.0, 100.0),
]


def fold(prices, period, seed="zero"):
    """RSI by the plain recurrence, one price at a time."""
    out, ag, al, seed_g, seed_l = [], 0.0, 0.0, 0.0, 0.0
    for i, price in enumerate(prices):
        change = price - prices[i - 1] if i else 0.0
        g, l = max(change, 0.0), max(-change, 0.0)
        if i < period:
            seed_g, seed_l = seed_g + g, seed_l + l
            out.append(0.0)
            continue
        if seed == "wilder" and i == period:
            ag, al = (seed_g + g) / period, (seed_l + l) / period
        else:
            ag, al = (ag * (period - 1) + g) / period, (al * (period - 1) + l) / period
        out.append(100.0 if al == 0 else 100.0 - 100.0 / (1.0 + ag / al))
    return out


def column(df, name):
    return [row[name] for row in df.orderBy("ticker", "tick_no").collect()]


def test_rsi_golden_values(make_ticks):
    pairs = [(f"S{n}", price) for n, case in enumerate(RSI_GOLDEN) for price in case[0]]
    for seed, at in (("zero", 1), ("wilder", 3)):
        known = with_indicators(make_ticks(pairs), IndicatorSpec(rsi_seed=seed))
        rows = known.orderBy("ticker", "tick_no").collect()
        for n, case in enumerate(RSI_GOLDEN):
            values = [row["rsi_14"] for row in rows if row["ticker"] == f"S{n}"]
            assert values[:14] == [0.0] * 14
            assert values[14] == pytest.approx(case[at], abs=1e-6)
            assert values[-1] == pytest.approx(case[at + 1], abs=1e-6)


def test_sma_golden_values(make_ticks):
    known = with_indicators(make_ticks([("A", p) for p in (10.0, 20.0, 30.0, 40.0)]), IndicatorSpec(sma=(1, 3), rsi=(), vwap=False))
    assert column(known, "sma_3") == [0.0, 0.0, 20.0, 30.0]
    assert column(known, "sma_1") == [10.0, 20.0, 30.0, 40.0]


def test_vwap_golden_values(make_ticks):
    spec = IndicatorSpec(sma=(), rsi=())
    ticks = make_ticks(
        [("A", 100.0), ("A", 200.0), ("A", 500.0), ("A", 500.0)],
        high=lambda i: [101.0, 202.0, 600.0, None][i],
        low=lambda i: [99.0, 198.0, 400.0, 400.0][i],
        volume=lambda i: [100, 900, 0, 50][i],
    )
    known = with_indicators(valid_ticks(ticks), spec)
    # Zero volume and a missing high leave the value as it was.
    assert column(known, "vwap") == pytest.approx([100.0, 190.0, 190.0, 190.0])


def test_vwap_is_zero_until_volume(make_ticks):
    known = with_indicators(make_ticks([("A", 1.0), ("A", 2.0)], volume=lambda i: i * 10), IndicatorSpec(sma=(), rsi=()))
    assert column(known, "vwap") == pytest.approx([0.0, 2.0])
    assert column(known, "vwap_ready") == [False, True]


@pytest.mark.parametrize("bad", [{"sma": (0,)}, {"rsi": (0,)}, {"rsi_seed": "other"}])
def test_bad_spec(bad):
    with pytest.raises(ValueError):
        IndicatorSpec(**bad)


def test_flat_stretch_keeps_the_index(make_ticks):
    """A long unchanged price leaves RSI where it was, however far the averages have decayed."""
    prices = [100.0 + (i * 7) % 5 for i in range(40)] + [103.0] * 2500 + [103.5]
    known = with_indicators(make_ticks([("A", p) for p in prices]))
    values = column(known, "rsi_14")
    assert values == pytest.approx(fold(prices, 14), abs=1e-6)
    assert len({round(v, 9) for v in values[40:2540]}) == 1


@pytest.mark.parametrize("spec", [
    IndicatorSpec(sma=(7, 300), rsi=(2, 14, 200), vwap=False),
    IndicatorSpec(sma=(3, 20, 600), rsi=(), vwap=False),
    IndicatorSpec(sma=(50,), rsi=(1, 2), vwap=False),
    IndicatorSpec(sma=(), rsi=(60,), vwap=False, rsi_seed="wilder"),
])
def test_far_apart_periods(make_ticks, spec):
    """Periods that need blocks of different sizes, over several blocks."""
    rng = random.Random(11)
    prices = [round(rng.uniform(1, 100), 2) for _ in range(2200)]
    rows = with_indicators(make_ticks([("A", p) for p in prices]), spec).orderBy("seq").collect()
    for p in spec.rsi:
        assert [row[f"rsi_{p}"] for row in rows] == pytest.approx(fold(prices, p, spec.rsi_seed), abs=1e-8)
    for p in spec.sma:
        means = [0.0 if i + 1 < p else sum(prices[i + 1 - p : i + 1]) / p for i in range(len(prices))]
        assert [row[f"sma_{p}"] for row in rows] == pytest.approx(means, abs=1e-9)


def test_ties_in_time_go_by_seq(make_ticks):
    prices = [10.0, 30.0, 20.0, 50.0, 40.0]
    known = with_indicators(make_ticks([("A", p) for p in prices], ts=lambda i: None), IndicatorSpec(sma=(2,), rsi=(2,), vwap=False))
    assert column(known, "sma_2") == [0.0, 20.0, 25.0, 35.0, 45.0]
    assert column(known, "rsi_2") == pytest.approx(fold(prices, 2))


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.floats(1, 1000), min_size=1, max_size=120),
    st.sampled_from([1, 2, 5, 14]),
    st.sampled_from(["zero", "wilder"]),
    st.lists(st.integers(1, 119), max_size=5),
)
def test_stepper_matches_the_fold(prices, period, seed, cuts):
    """Advancing in arbitrary batches equals the recurrence price by price."""
    spec = IndicatorSpec(sma=(period,), rsi=(period,), rsi_seed=seed)
    state, got, sma = TickerState.start(spec), [], []
    edges = [0, *sorted({c for c in cuts if c < len(prices)}), len(prices)]
    for lo, hi in zip(edges, edges[1:]):
        out = advance(state, np.asarray(prices[lo:hi]), spec)
        got += out[f"rsi_{period}"].tolist()
        sma += out[f"sma_{period}"].tolist()
    assert got == pytest.approx(fold(prices, period, seed), abs=1e-6)
    assert all(0.0 <= value <= 100.0 for value in got)
    means = [0.0 if i + 1 < period else sum(prices[i + 1 - period : i + 1]) / period for i in range(len(prices))]
    assert sma == pytest.approx(means)


def _hot_case(seed):
    rng = random.Random(seed)
    pairs, price = [], 50.0
    for i in range(1500):
        if i < 500 or i > 900:  # an unchanged price in between
            price = max(1.0, price + rng.choice([-1.5, -0.5, 0.0, 0.5, 1.5]))
        pairs.append(("HOT" if rng.random() < 0.6 else f"C{rng.randrange(4)}", price))
    return pairs


@pytest.mark.parametrize("seed", ["zero", "wilder"])
@pytest.mark.parametrize("rows_per_piece", [20, 70, 400])
def test_split_ticker_equals_whole_ticker(make_ticks, seed, rows_per_piece):
    ticks = make_ticks(_hot_case(rows_per_piece), volume=lambda i: i % 5)
    spec = IndicatorSpec(sma=(5, 20), rsi=(1, 3, 14), rsi_seed=seed)
    names = ("seq", "tick_no", "sma_5", "sma_20", "rsi_1", "rsi_3", "rsi_14", "vwap", "vwap_ready", "next_price")
    whole = with_indicators(ticks, spec, keep_pieces=True).orderBy("seq").collect()
    parts = with_indicators(ticks, spec, HotSplit(rows_per_piece), keep_pieces=True).orderBy("seq").collect()
    assert max(row["piece"] for row in parts) > 1
    assert max(row["piece"] for row in whole) == 0
    for name in names:
        a, b = [row[name] for row in parts], [row[name] for row in whole]
        assert a == (b if b[0] is None or name == "next_price" else pytest.approx(b, abs=1e-8)), name


def test_split_survives_one_instant(make_ticks):
    """Every tick at the same time: pieces are still cut, by seq."""
    ticks = make_ticks([("A", float(1 + i % 7)) for i in range(300)], ts=lambda i: None)
    whole = with_indicators(ticks).orderBy("seq").collect()
    parts = with_indicators(ticks, split=HotSplit(40), keep_pieces=True).orderBy("seq").collect()
    assert parts[-1]["piece"] > 2
    assert [r["rsi_14"] for r in parts] == pytest.approx([r["rsi_14"] for r in whole], abs=1e-9)


def test_piece_count_is_bounded(make_ticks):
    ticks = make_ticks([("A", 1.0 + i % 3) for i in range(200)])
    parts = with_indicators(ticks, split=HotSplit(rows_per_piece=1, max_pieces=5), keep_pieces=True)
    assert parts.select("piece").distinct().count() <= 5


def test_entries_too_large_to_broadcast_are_joined(make_ticks, monkeypatch):
    from tickloom.operators import indicators

    ticks = make_ticks([("A", 10.0 + (i * 3) % 11) for i in range(300)])
    whole = [r["rsi_14"] for r in with_indicators(ticks).orderBy("seq").collect()]
    hints = lambda df: df._jdf.queryExecution().analyzed().toString().count("ResolvedHint")
    usual = hints(with_indicators(ticks, split=HotSplit(80)))
    monkeypatch.setattr(indicators, "_BROADCAST_BYTES", 0)
    parts = with_indicators(ticks, split=HotSplit(80))
    assert hints(parts) == usual - 1
    assert [r["rsi_14"] for r in parts.orderBy("seq").collect()] == pytest.approx(whole)


def test_split_with_reset(make_ticks):
    ticks = make_ticks([("A", 10.0 + (i * 3) % 11) for i in range(400)]).selectExpr("*", "seq >= 250 as half")
    spec = IndicatorSpec(sma=(5,), rsi=(3,), reset_by=("half",))
    whole = with_indicators(ticks, spec).orderBy("seq").collect()
    parts = with_indicators(ticks, spec, HotSplit(60)).orderBy("seq").collect()
    assert whole[250]["tick_no"] == 1
    for name in ("tick_no", "sma_5", "rsi_3", "vwap"):
        assert [r[name] for r in parts] == pytest.approx([r[name] for r in whole])


def test_enrich_drops_invalid_and_flags_ready(make_ticks):
    pairs = [("A", 100.0)] * 49 + [("A", 0.0), ("A", -3.0), (None, 5.0), ("A", float("nan")), ("A", None)] + [("A", 100.0)] * 2
    rows = enrich(make_ticks(pairs)).orderBy("seq").collect()
    assert len(rows) == 51
    assert [row["indicators_ready"] for row in rows] == [False] * 49 + [True] * 2
    assert rows[-1]["indicators"]["sma_50"] == pytest.approx(100.0)


def test_session_vwap_starts_anew(make_ticks):
    ticks = make_ticks([("A", 10.0), ("A", 20.0), ("A", 40.0)], ts=lambda i: START + timedelta(hours=8 * i))
    # 14:30 and 22:30 of one day, 06:30 of the next.
    assert [r["vwap"] for r in session_vwap(ticks).orderBy("seq").collect()] == pytest.approx([10.0, 15.0, 40.0])


def test_vwap_stays_between_typical_prices(make_ticks):
    rng = random.Random(3)
    ticks = make_ticks([("A", rng.uniform(1, 9)) for _ in range(200)], volume=lambda i: i % 7)
    rows = with_indicators(ticks).orderBy("seq").collect()
    seen = []
    for row in rows:
        if row["volume"] > 0:
            seen.append((row["high"] + row["low"] + row["price"]) / 3)
        if seen:
            assert min(seen) - 1e-9 <= row["vwap"] <= max(seen) + 1e-9


def test_signals(make_ticks):
    rows = with_signals(make_ticks([("A", 100.0 + i) for i in range(20)])).orderBy("seq").collect()
    assert [row["rsi_signal"] for row in rows] == [None] * 14 + ["overbought"] * 6
    assert rows[0]["vwap_signal"] == "fair" and rows[-1]["vwap_signal"] == "above"


def test_stream_is_refused(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        with_indicators(stream)
