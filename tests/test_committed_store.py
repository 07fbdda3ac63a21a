"""Stored points that are committed run by run."""

from __future__ import annotations

import glob
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators.enrich import enrich
from tickloom.sources import store

from .conftest import START


def seqs(spark, path):
    return sorted(r["seq"] for r in store.read_committed(spark, path).collect())


def test_runs_replace_themselves_and_are_seen_whole(spark, make_ticks, tmp_path, monkeypatch):
    ticks = enrich(make_ticks([("AB"[i % 2], 10.0 + i) for i in range(40)], ts=lambda i: START + timedelta(hours=3 * i))).persist()
    part = lambda lo, hi: ticks.where((F.col("seq") >= lo) & (F.col("seq") < hi))
    path = str(tmp_path / "store")
    store.commit_points(part(0, 10), path, "a")
    store.commit_points(part(10, 30), path, "b")
    store.commit_points(part(10, 30), path, "b")
    assert seqs(spark, path) == list(range(30))
    # A run that breaks off between its rows and its commit is not seen, and is made again.
    newest = store._newest
    monkeypatch.setattr(store, "_newest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store._commit_run(store.to_points(part(30, 40)), path, "c", ["a", "b", "c"])
    monkeypatch.setattr(store, "_newest", newest)
    assert seqs(spark, path) == list(range(30))
    store.commit_points(part(30, 40), path, "c")
    with pytest.raises(ValueError):
        store.commit_points(ticks, path, "a/b")
    assert seqs(spark, path) == list(range(40))


def test_small_runs_are_put_together(spark, make_ticks, tmp_path):
    ticks = enrich(make_ticks([("A", 10.0 + i) for i in range(24)], ts=lambda i: START + timedelta(hours=4 * i))).persist()
    path = str(tmp_path / "store")
    for i in range(12):
        store.commit_points(ticks.where(F.col("seq") % 12 == i), path, f"{i:02d}")
    before = sorted(map(str, store.read_committed(spark, path).collect()))
    with pytest.raises(ValueError):
        store.compact_points(spark, path, "03")
    store.compact_points(spark, path, "all")
    assert sorted(map(str, store.read_committed(spark, path).collect())) == before
    dates = {r["dt"] for r in store.read_committed(spark, path).collect()}
    files = glob.glob(f"{path}/data/run=run-all/dt=*/*.parquet")
    assert len(files) <= len(dates) + 4 < len(glob.glob(f"{path}/data/run=*/dt=*/*.parquet")) - len(files)
    one = sorted(dates)[1]
    plan = store.read_committed(spark, path).where(F.col("dt") == F.lit(one))._jdf.queryExecution().executedPlan().toString()
    partitions = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "dt" in partitions and "run" in partitions
