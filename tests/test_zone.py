"""Days and texts are in UTC, whatever the time zone of the session."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns as C
from tickloom.operators.enrich import enrich, session_vwap
from tickloom.plans import dashboard
from tickloom.plans.candles import daily_summary
from tickloom.sources import store
from tickloom.sources.topics import message_number


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


MIDNIGHT = datetime(2024, 3, 10, tzinfo=timezone.utc)  # clocks in New York go forward on this day


def test_days_texts_and_stored_dates(spark, make_ticks, zone, tmp_path):
    ticks = make_ticks([("A", 10.0 + i) for i in range(48)], ts=lambda i: MIDNIGHT + timedelta(hours=i - 20, seconds=5))
    days = {r["dt"]: (r["open"], r["close"], r["ticks"]) for r in daily_summary(ticks).collect()}
    assert days == {date(2024, 3, 9): (10.0, 29.0, 20), date(2024, 3, 10): (30.0, 53.0, 24), date(2024, 3, 11): (54.0, 57.0, 4)}
    firsts = [r for r in session_vwap(ticks).orderBy("seq").collect() if r["seq"] in (0, 20, 44)]
    assert all(r["vwap"] == pytest.approx(r["price"]) for r in firsts)
    texts = [r[0] for r in ticks.orderBy("seq").select(C.iso_text(F.col("ts"))).collect()]
    assert texts[0] == "2024-03-09T04:00:05Z" and texts[19:21] == ["2024-03-09T23:00:05Z", "2024-03-10T00:00:05Z"]
    store.write_points(enrich(ticks), str(tmp_path / "points"))
    points = store.read_points(spark, str(tmp_path / "points"))
    assert {str(r["dt"]): r["n"] for r in points.groupBy("dt").agg(F.count("*").alias("n")).collect()} == {
        "2024-03-09": 20, "2024-03-10": 24, "2024-03-11": 4
    }
    recent = dashboard.within(points, "24h", dashboard.just_after_latest(points))
    assert recent.count() == 24


def test_texts_before_1970_and_of_nothing(spark, zone):
    row = spark.sql("SELECT timestamp_micros(-1) AS a, CAST(NULL AS TIMESTAMP) AS b").select(C.iso_text(F.col("a")), C.iso_text(F.col("b"))).first()
    assert tuple(row) == ("1969-12-31T23:59:59Z", None)


def test_message_numbers_are_unique_and_rise_with_the_offset(spark):
    rows = [(t, p, o) for t in ("b", "a", "c") for p in (0, 1, 4095) for o in (0, 1, 2**40)]
    table = spark.createDataFrame(rows, "topic STRING, partition INT, offset LONG")
    number = message_number(["a", "b", "c"], F.col("topic"), F.col("partition"), F.col("offset"))
    found = [tuple(r) for r in table.select("topic", "partition", "offset", number.alias("n")).orderBy("n").collect()]
    assert len({n for *_, n in found}) == len(rows) and min(n for *_, n in found) == 0
    assert [(o, p, t) for t, p, o, _ in found] == sorted((o, p, t) for t, p, o in rows)
    with pytest.raises(ValueError):
        message_number([str(i) for i in range(65)], F.col("t"), F.col("p"), F.col("o"))
