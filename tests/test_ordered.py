"""Streams that put late ticks in their place or reject them."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators.enrich import enrich
from tickloom.schema import RAW_TICK
from tickloom.streaming import sinks
from tickloom.streaming.ordered import LATE, enrich_ordered, use_rocksdb, use_state_store

from .conftest import START


@pytest.fixture
def rocksdb(spark):
    before = use_rocksdb(spark)
    yield
    use_state_store(spark, before)


@pytest.fixture
def feed(spark, tmp_path, rocksdb):
    """Rows in batches through a stream that starts anew for each; what came out."""

    def run(batches, **options):
        folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
        for batch in batches:
            batch.write.mode("append").parquet(folder)
            rows = enrich_ordered(spark.readStream.schema(RAW_TICK).parquet(folder), **options)
            sinks.to_files(rows, out, state, drain=True).awaitTermination()
        return spark.read.parquet(out)

    return run


def at(times):
    return {"ts": lambda i: START + timedelta(seconds=times[i]), "seq": lambda i: i}


def parts(ticks, bounds):
    return [ticks.where((F.col("seq") >= lo) & (F.col("seq") < hi)) for lo, hi in zip(bounds, bounds[1:])]


def test_disorder_within_the_delay_changes_nothing(make_ticks, feed):
    rng = random.Random(3)
    times = [10 * i + rng.randrange(-55, 56) for i in range(120)] + [100_000]
    pairs = [(None if i % 31 == 0 else "AB"[i % 3 == 0], 0.0 if i % 29 == 0 else 50.0 + (i * 7) % 13) for i in range(120)] + [("END", 1.0)]
    ticks = make_ticks(pairs, volume=lambda i: i % 4, **at(times))
    got = feed(parts(ticks, [0, 30, 71, 120, 121]), delay="2m")
    want = {r["seq"]: r for r in enrich(ticks.where("ticker <> 'END'")).collect()}
    found = {r["seq"]: r for r in got.collect()}
    assert found.keys() == want.keys() and got.count() == len(want) and got.where("reject_reason IS NOT NULL").count() == 0
    for seq, row in want.items():
        assert found[seq]["indicators_ready"] == row["indicators_ready"]
        for name in ("sma_20", "sma_50", "rsi_14", "vwap"):
            assert found[seq]["indicators"][name] == pytest.approx(row["indicators"][name], abs=1e-8)


def test_late_ticks_are_rejected_once(make_ticks, feed):
    # The second batch comes when the watermark stands at 100 - 60 = 40 seconds.
    times = [0, 100, 39, 40, 41, 70, 10_000]
    ticks = make_ticks([("A", 1.0 + i) for i in range(6)] + [("END", 1.0)], **at(times))
    rows = feed(parts(ticks, [0, 2, 6, 7]), delay="1m").collect()
    assert {r["seq"]: r["reject_reason"] for r in rows} == {0: None, 1: None, 2: LATE, 3: LATE, 4: None, 5: None}
    assert len(rows) == 6


def test_silent_tickers_are_forgotten(make_ticks, feed):
    times = list(range(60)) + [2000, 20_000, 20_001, 40_000]
    pairs = [("A", 10.0 + i) for i in range(60)] + [("B", 1.0), ("A", 5.0), ("A", 6.0), ("END", 1.0)]
    ticks = make_ticks(pairs, **at(times))
    bounds = [0, 60, 61, 63, 64]
    kept = {r["seq"]: r["indicators_ready"] for r in feed(parts(ticks, bounds), delay="1m", forget_after="10m").collect()}
    assert kept[59] and not kept[61] and not kept[62] and len(kept) == 63


def test_other_state_stores_are_refused(make_ticks):
    with pytest.raises(ValueError):
        enrich_ordered(make_ticks([("A", 1.0)]))
