"""The versioned subscription table."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest

from tickloom.operators import routing
from tickloom.streaming import subscription_table as S

from .conftest import START
from .test_routing import LOG, brute


def batches(spark, seed=4):
    rng = random.Random(seed)
    actions = [(f"c{i}", "open", None) for i in range(5)]
    for _ in range(120):
        actions.append((f"c{rng.randrange(6)}", rng.choice(["subscribe", "unsubscribe"]), rng.sample("ABCD", rng.randrange(3))))
        if rng.random() < 0.02:
            actions.append((f"c{rng.randrange(5)}", "close", None))
    cuts = [0, 4, 50, 51, 90, len(actions)]
    log = lambda lo, hi: spark.createDataFrame([(*a, START + timedelta(seconds=lo + i), lo + i) for i, a in enumerate(actions[lo:hi])], LOG)
    return actions, cuts, [log(lo, hi) for lo, hi in zip(cuts, cuts[1:])]


def lists(spark, path, version=None):
    return {r["client_id"]: set(r["tickers"]) for r in routing.lists_of(S.snapshot(spark, path, version)).collect()}


@pytest.mark.parametrize("compact_every", [1, 2, 100])
def test_every_version_can_be_read(spark, tmp_path, compact_every):
    actions, cuts, parts = batches(spark)
    path, run = str(tmp_path / "table"), S.upsert_sink(str(tmp_path / "table"), compact_every)
    for number, part in enumerate(parts):
        run(part, number)
    for number, end in enumerate(cuts[1:]):
        assert lists(spark, path, number) == brute(actions[:end])
    assert lists(spark, path) == brute(actions) and S.newest_version(spark, path) == 4
    routes = {(r["client_id"], r["route"]) for r in routing.routes_of(S.snapshot(spark, path, 2)).collect()}
    assert routes == {(c, f"={t}") for c, held in brute(actions[:51]).items() for t in held} | {(c, "*") for c, held in brute(actions[:51]).items() if not held}


def test_repeated_and_unfinished_batches(spark, tmp_path, monkeypatch):
    actions, cuts, parts = batches(spark, 9)
    path, run = str(tmp_path / "table"), S.upsert_sink(str(tmp_path / "table"), 2)
    with pytest.raises(ValueError):
        S.snapshot(spark, path)
    for number in (0, 1, 1):
        run(parts[number], number)
    assert lists(spark, path) == brute(actions[: cuts[2]])
    # The next batch fails after it has written its rows, and then runs again.
    commit = S._commit
    monkeypatch.setattr(S, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run(parts[2], 2)
    assert lists(spark, path) == brute(actions[: cuts[2]]) and S.newest_version(spark, path) == 1
    with pytest.raises(ValueError):
        S.snapshot(spark, path, 2)
    monkeypatch.setattr(S, "_commit", commit)
    run(parts[2], 2)
    run(parts[3], 3)
    assert lists(spark, path) == brute(actions[: cuts[4]]) and lists(spark, path, 2) == brute(actions[: cuts[3]])
