"""Numbers that are not finite, in every field."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import normalize, reshape, summary, validate
from tickloom.streaming import health

ODD = (float("nan"), float("inf"), float("-inf"))


@pytest.mark.parametrize("field", ["price", "open", "high", "low"])
@pytest.mark.parametrize("odd", ODD)
def test_ticks(make_ticks, field, odd):
    ticks = make_ticks([("A", 10.0 + i) for i in range(6)], **{field: lambda i: odd if i == 2 else 10.0 + i})
    good, bad = validate.valid_ticks(ticks), validate.rejected_ticks(ticks)
    assert good.count() + bad.count() == 6 and bad.count() == (field == "price")
    assert all(math.isfinite(r[name]) for r in good.collect() for name in ("price", "open", "high", "low"))
    assert all(math.isfinite(r["vwap"]) for r in summary.vwap_total(ticks).collect())


@pytest.mark.parametrize("number", ["NaN", "Infinity", "-Infinity"])
def test_documents(spark, number):
    body = f'{{"status": "OK", "results": {{"p": {number}, "s": 5, "t": 1}}}}'
    landed = spark.createDataFrame([(1, "A", body)], "seq LONG, ticker STRING, body STRING").withColumn("fetched_at", F.current_timestamp())
    assert normalize.quotes_source_two(landed).first()["reject_reason"] is not None
    value = f'{{"price": 5.0, "high": {number}, "low": 4.0}}'
    messages = spark.createDataFrame([(1, "A", value)], "seq LONG, key STRING, value STRING").withColumn("ts", F.current_timestamp())
    row = normalize.decode_messages(messages).first()
    assert row["reject_reason"] is not None or row["high"] == 0.0


def test_points_of_plain_ticks(make_ticks):
    points = reshape.to_points(make_ticks([("A", 0.0), ("A", 3.0)])).collect()
    assert sorted(r.price for r in points) == [0.0, 3.0] and all(r.sma_20 is None and r.vwap is None for r in points)


def test_counters_cover_every_batch(spark, make_ticks, tmp_path):
    """More batches than a query keeps progress of, and one that is repeated."""
    ticks = make_ticks([("A", 1.0), ("B", float("nan")), (None, 2.0)]).persist()
    for batch in [*range(120), 7]:
        health.write_counters(ticks, batch, str(tmp_path))
    totals = health.read_counters(spark, str(tmp_path)).agg(F.sum("ticks"), F.sum("valid"), F.count("*")).first()
    assert tuple(totals) == (360, 120, 120)


@pytest.mark.parametrize("odd", ODD)
def test_odd_prices_are_not_stored(make_ticks, odd):
    ticks = make_ticks([("A", 1.0), ("A", odd), (None, 2.0), ("A", 0.0), ("A", None)])
    assert sorted(r["price"] for r in reshape.to_points(ticks).collect()) == [0.0, 1.0]
    reasons = {r["seq"]: r["reject_reason"] for r in validate.unstorable(ticks).collect()}
    assert reasons == {1: "price_not_finite", 2: "missing_ticker", 4: "price_not_finite"}
