"""The physical plans the design relies on."""

from __future__ import annotations

import __spark_entry__ as entry
from tickloom.functions.stepper import IndicatorSpec
from tickloom.operators import retain, routing
from tickloom.operators.indicators import with_indicators
from tickloom.operators.validate import valid_ticks
from tickloom.plans import dashboard
from tickloom.plans.backtest import backtest
from tickloom.plans.candles import candles
from tickloom.plans.correlation import correlation
from tickloom.sources.ticks import read_events, ticks_from_events

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ticks(spark):
    return ticks_from_events(read_events(spark, FOLDER))


def test_all_indicators_share_one_shuffle(spark):
    text = plan(with_indicators(valid_ticks(ticks(spark))))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 2
    assert "Python" not in text


def test_backtest_grid_shares_one_shuffle(spark):
    assert plan(backtest(ticks(spark))).count("Exchange") == 1


def test_scan_reads_needed_columns_only(spark):
    text = plan(with_indicators(valid_ticks(ticks(spark)), IndicatorSpec(vwap=False)).select("seq", "sma_20"))
    schema = text[text.index("ReadSchema:") :]
    assert "props" not in schema and "event_type" not in schema


def test_candles_aggregate_before_the_shuffle(spark):
    text = plan(candles(ticks(spark)))
    assert text.count("Exchange") == 1 and "partial_min_by" in text[text.index("Exchange") :]


def test_newest_n_is_limited_before_each_shuffle(spark):
    text = plan(retain.newest_n(valid_ticks(ticks(spark)), 5))
    assert text.count("Partial") == 2 and text.count("Exchange") == 2


def test_top_movers_is_a_top_k(spark):
    points = valid_ticks(ticks(spark))
    text = plan(dashboard.top_movers(points, 5, "24h", dashboard.just_after_latest(points)))
    assert "TakeOrderedAndProject" in text and "Join" not in text


def test_correlation_has_no_join(spark):
    assert "Join" not in plan(correlation(ticks(spark)))


def test_large_target_tables_are_not_broadcast(spark):
    log = entry._log(spark, FOLDER)
    routed = routing.route_ticks(valid_ticks(ticks(spark)), routing.routes(log), broadcast_rows=0)
    assert "_salt" in routed._jdf.queryExecution().optimizedPlan().toString()
