from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import reshape, retain
from tickloom.operators.enrich import enrich
from tickloom.plans import dashboard as D
from tickloom.schema import INDICATOR_FIELDS
from tickloom.sources import store

from .conftest import START


def at(**delta):
    return F.lit(START + timedelta(**delta))


def test_points_are_gated(make_ticks):
    points = reshape.to_points(enrich(make_ticks([("A", 100.0 + i) for i in range(60)]))).orderBy("seq").collect()
    assert all(row[name] is None for row in points[:49] for name in INDICATOR_FIELDS)
    assert all(row[name] is not None for row in points[49:] for name in INDICATOR_FIELDS)


def test_points_need_ticker_and_price_only(make_ticks, spark):
    block = F.struct(*[F.lit(1.0).alias(name) for name in INDICATOR_FIELDS])
    ticks = make_ticks([("A", 0.0), (None, 1.0), ("A", None), ("A", 2.0)], source=None, volume=None)
    points = reshape.to_points(ticks.withColumns({"indicators": block, "indicators_ready": F.col("price") > 1})).orderBy("seq").collect()
    assert [(p["seq"], p["source"], p["volume"], p["vwap"]) for p in points] == [(0, "unknown", 0, None), (3, "unknown", 0, 1.0)]


def test_wide_form_moves_rows_once_and_keeps_none_back(make_ticks):
    plan = reshape.to_wide(reshape.to_long(reshape.to_points(make_ticks([("A", 1.0), ("B", 2.0)]))))
    lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [at for at, line in enumerate(lines) if "Exchange" in line]
    assert len(moved) == 1 and not any("Aggregate" in line for line in lines[moved[0] :])


def test_long_and_back(make_ticks):
    points = reshape.to_points(enrich(make_ticks([("A", 100.0 + i) for i in range(55)])))
    long = reshape.to_long(points)
    assert long.count() == 55 * 5 + 6 * 4
    back = reshape.to_wide(long).withColumn("volume", F.col("volume").cast("long")).select(*points.columns)
    assert back.exceptAll(points).count() == points.exceptAll(back).count() == 0


def test_table_round_trip_prunes_dates(make_ticks, spark, tmp_path):
    enriched = enrich(make_ticks([("A", 100.0 + i % 9) for i in range(120)], ts=lambda i: START + timedelta(hours=i)))
    path = str(tmp_path / "points")
    store.write_points(enriched, path)
    points = store.read_points(spark, path)
    assert points.count() == 120 and points.select("dt").distinct().count() == 6
    found = D.indicator_history(points, "A", "24h", at(hours=120))
    assert found.count() == 24
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert "EqualTo(ticker,A)" in plan


def test_range_includes_start_and_excludes_end(make_ticks):
    ticks = make_ticks([("A", float(i + 1)) for i in range(4)], ts=lambda i: START + timedelta(minutes=30 * i))
    prices = lambda as_of: [r["price"] for r in D.price_history(ticks, "A", "1h", as_of).collect()]
    assert prices(at(minutes=60)) == [1.0, 2.0]
    assert prices(at(minutes=61)) == [2.0, 3.0]
    assert prices(D.just_after_latest(ticks)) == [3.0, 4.0]
    assert prices(None) == []


def test_latest_tick(make_ticks):
    ticks = make_ticks([("A", 1.0), ("A", 2.0), ("B", 3.0)])
    now = D.just_after_latest(ticks)
    assert [(r["ticker"], r["price"]) for r in D.latest_tick(ticks, "A", now).collect()] == [("A", 2.0)]
    assert D.latest_tick(ticks, "Z", now).collect() == []


def test_top_movers(make_ticks):
    ticks = make_ticks([("UP", 10.0), ("DOWN", 10.0), ("ZERO", 0.0), ("UP", 12.0), ("DOWN", 5.0), ("ZERO", 1.0)])
    now = D.just_after_latest(ticks)
    signed = [(r["ticker"], r["change_pct"]) for r in D.top_movers(ticks, 3, "1h", now).collect()]
    assert signed == [("UP", pytest.approx(20.0)), ("DOWN", pytest.approx(-50.0)), ("ZERO", None)]
    assert [r["ticker"] for r in D.top_movers(ticks, 1, "1h", now, by="abs").collect()] == ["DOWN"]
    with pytest.raises(ValueError):
        D.top_movers(ticks, by="other")


def test_movers_and_summary_per_source(make_ticks):
    ticks = make_ticks([("A", 10.0), ("A", 100.0), ("A", 20.0), ("A", 110.0)], source=lambda i: ("x", "y")[i % 2])
    now = D.just_after_latest(ticks)
    assert [(r["source"], round(r["change_pct"])) for r in D.top_movers(ticks, 5, "1h", now, per_source=True).collect()] == [("x", 100), ("y", 10)]
    assert [r["price"] for r in D.market_summary(ticks, now).collect()] == [110.0]
    assert [(r["source"], r["price"]) for r in D.market_summary(ticks, now, per_source=True).collect()] == [("x", 20.0), ("y", 110.0)]


def test_newest_oldest_overwritten(make_ticks):
    ticks = make_ticks([("A", 100.0), ("A", 200.0), ("A", 300.0), ("A", 400.0), ("B", 1.0)]).repartition(4)
    kept = retain.newest_n(ticks, 3)
    assert sorted(r["price"] for r in kept.collect()) == [1.0, 200.0, 300.0, 400.0]
    assert {r["ticker"]: r["overwritten"] for r in retain.overwritten(ticks, 3).collect()} == {"A": 1, "B": 0}
    assert [r["price"] for r in retain.newest_n(ticks, 2, per_ticker=False).collect()] == [1.0, 400.0]
    assert [r["price"] for r in retain.oldest_n(ticks, 2).collect()] == [100.0, 200.0]
