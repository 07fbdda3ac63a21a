from __future__ import annotations

import json
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import reshape
from tickloom.operators.enrich import enrich
from tickloom.operators.normalize import accepted, decode_messages, quotes_source_two
from tickloom.operators.routing import subscription_lists
from tickloom.operators.summary import summary_sink, ticker_summary
from tickloom.plans.candles import candles
from tickloom.schema import RAW_TICK
from tickloom.sources import topics
from tickloom.streaming import health, sinks
from tickloom.streaming.enrich import counted_stream, enrich_stream
from tickloom.streaming.subscriptions import subscription_feed

from .conftest import START
from .test_routing import ACTIONS, LOG, log_of


@pytest.fixture
def chunks(tmp_path):
    """Write row ranges as files whose times rise, because a file source reads by time."""

    def write(df, bounds, name="in"):
        folder = tmp_path / name
        for lo, hi in zip(bounds, bounds[1:]):
            part = tmp_path / f"{name}-{lo}"
            df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.parquet(str(part))
            folder.mkdir(exist_ok=True)
            (file,) = part.glob("*.parquet")
            target = folder / f"{lo:06d}.parquet"
            target.write_bytes(file.read_bytes())
            os.utime(target, (1_700_000_000 + lo, 1_700_000_000 + lo))
        return str(folder)

    return write


def stream_of(spark, folder, schema=RAW_TICK):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same(a, b, names=("sma_20", "sma_50", "rsi_14", "vwap")):
    a, b = a.orderBy("seq").collect(), b.orderBy("seq").collect()
    assert [r["seq"] for r in a] == [r["seq"] for r in b]
    for x, y in zip(a, b):
        assert x["indicators_ready"] == y["indicators_ready"]
        for name in names:
            assert x["indicators"][name] == pytest.approx(y["indicators"][name], abs=1e-8)


@pytest.mark.parametrize("seed", ["zero", "wilder"])
def test_stream_equals_batch_and_resumes(spark, make_ticks, chunks, tmp_path, seed):
    pairs = [(None if i % 31 == 0 else "AB"[i % 3 == 0], 0.0 if i % 29 == 0 else 50.0 + (i * 7) % 13) for i in range(400)]
    ticks = make_ticks(pairs, volume=lambda i: i % 4)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    folder = chunks(ticks, [0, 5, 60, 200])
    sinks.to_files(enrich_stream(stream_of(spark, folder), seed), out, state, drain=True).awaitTermination()
    # More files arrive, and a new query goes on from the checkpoint.
    chunks(ticks, [200, 333, 400])
    sinks.to_files(enrich_stream(stream_of(spark, folder), seed), out, state, drain=True).awaitTermination()
    same(spark.read.parquet(out), enrich(ticks, seed))


def test_stream_into_store_and_topic(spark, make_ticks, chunks, tmp_path):
    ticks = make_ticks([("A", 10.0 + i % 7) for i in range(120)])
    folder = chunks(ticks, [0, 70, 120])
    path, sent = str(tmp_path / "points"), []
    query = sinks.to_store_and(
        enrich_stream(stream_of(spark, folder)), path, lambda batch, n: sent.append((n, batch.count())), str(tmp_path / "state"), drain=True
    )
    query.awaitTermination()
    assert sent == [(0, 70), (1, 50)]
    stored = spark.read.parquet(path).select(*reshape.to_points(enrich(ticks)).columns)
    expected = reshape.to_points(enrich(ticks))
    rounded = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("seq", "price", "volume", F.coalesce("rsi_14", F.lit(-1.0)), F.coalesce("vwap", F.lit(-1.0))).collect())
    assert rounded(stored) == rounded(expected)


def test_batch_that_runs_again_replaces_its_rows(spark, make_ticks, tmp_path, monkeypatch):
    """A store write that is repeated after a failure in the second sink leaves no doubles."""
    ticks = make_ticks([("A", 10.0 + i) for i in range(20)])
    folder, state, path = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "points")
    ticks.write.parquet(folder)

    def fail(batch, batch_id):
        raise RuntimeError("sink down")

    query = sinks.to_store_and(enrich_stream(stream_of(spark, folder)), path, fail, state, drain=True)
    with pytest.raises(Exception, match="sink down"):
        query.awaitTermination()
    first = spark.read.parquet(path).count()
    sinks.to_store_and(enrich_stream(stream_of(spark, folder)), path, lambda b, n: None, state, drain=True).awaitTermination()
    assert first > 0 and spark.read.parquet(path).count() == 20


def test_candles_close_with_the_watermark(spark, make_ticks, chunks, tmp_path):
    ticks = make_ticks([("A", 1.0 + i % 5) for i in range(60)], ts=lambda i: START + timedelta(minutes=10 * i))
    out = str(tmp_path / "out")
    live = candles(stream_of(spark, chunks(ticks, [0, 20, 60])), "1h", late="1h")
    sinks.to_files(live, out, str(tmp_path / "state"), drain=True).awaitTermination()
    closed = START + timedelta(minutes=590) - timedelta(hours=1)
    expected = candles(ticks, "1h").where(F.col("bucket") + F.expr("INTERVAL 1 HOUR") <= F.lit(closed))
    got = spark.read.parquet(out)
    assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
    assert got.count() == 9


def test_topics_of_files(spark, make_ticks, tmp_path):
    ticks = make_ticks([("A" if i % 2 else "B", 5.0 + i % 9) for i in range(130)])
    names = [str(tmp_path / "one"), str(tmp_path / "two")]
    topics.publish(ticks.where("seq < 100"), names[0], "parquet")
    topics.publish(ticks.where("seq >= 100"), names[1], "parquet")
    decoded = accepted(decode_messages(topics.read_topic(spark, names, "parquet"))).drop("raw", "indicators", "indicators_ready")
    target = str(tmp_path / "processed")
    writer = topics.write_topic(enrich_stream(decoded), target, str(tmp_path / "state"), "parquet")
    writer.trigger(availableNow=True).start().awaitTermination()
    same(accepted(decode_messages(spark.read.schema(topics.MESSAGE).parquet(target))), enrich(ticks))


def test_feed(spark, tmp_path, chunks):
    log = log_of(spark, ACTIONS)
    out = str(tmp_path / "out")
    feed = subscription_feed(stream_of(spark, chunks(log, [0, 6, 9, 20]), LOG))
    sinks.to_files(feed, out, str(tmp_path / "state"), drain=True).awaitTermination()
    rows = [(r["client_id"], r["seq"], r["tickers"]) for r in spark.read.schema(feed.schema).parquet(out).orderBy("seq").collect()]
    assert rows == [("one", 4, ["A", "B"]), ("one", 5, ["A"]), ("none", 7, ["A"]), ("none", 8, []), ("gone", 10, ["A"]), ("one", 15, ["A"])]
    assert {r["client_id"]: r["tickers"] for r in subscription_lists(log).collect()}["one"] == rows[-1][2]


def test_feed_of_many_clients_keeps_few_states(spark, tmp_path, chunks):
    actions = [(f"c{i}", "open", None) for i in range(40)] + [(f"c{i % 40}", "subscribe", ["AB"[i % 3 % 2]]) for i in range(200)]
    actions += [(f"c{i}", "close", None) for i in range(0, 40, 2)] + [(f"c{i}", "unsubscribe", ["B"]) for i in range(40)]
    log, out = log_of(spark, actions), str(tmp_path / "out")
    feed = subscription_feed(stream_of(spark, chunks(log, [0, 130, 250, 300]), LOG), buckets=4)
    query = sinks.to_files(feed, out, str(tmp_path / "state"), drain=True)
    query.awaitTermination()
    held, want = {}, []
    for seq, (client, action, tickers) in enumerate(actions):
        if action == "open":
            held[client] = set()
        elif action == "close":
            del held[client]
        elif client in held:
            held[client] = held[client] | set(tickers) if action == "subscribe" else held[client] - set(tickers)
            want.append((client, seq, sorted(held[client])))
    rows = spark.read.schema(feed.schema).parquet(out).orderBy("seq").collect()
    assert [(r["client_id"], r["seq"], r["tickers"]) for r in rows] == want
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 4


def test_health(spark, make_ticks, chunks, tmp_path):
    ticks = make_ticks([("A", 1.0), (None, 1.0), ("B", 0.0), ("B", 2.0)])
    listener = health.HealthListener()
    spark.streams.addListener(listener)
    try:
        stream = enrich_stream(counted_stream(stream_of(spark, chunks(ticks, [0, 2, 4]))))
        query = sinks.to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"), drain=True)
        query.awaitTermination()
        rows = health.health_report(spark, query).orderBy("batch").collect()
    finally:
        spark.streams.removeListener(listener)
    assert [(r["ticks"], r["valid"]) for r in rows if r["ticks"]] == [(2, 1), (2, 1)]
    assert rows[-1]["in_state"] == 2


def test_summary_per_micro_batch(spark, make_ticks, tmp_path):
    ticks = make_ticks([("A", 1.0 + i) for i in range(10)])
    ticks.write.parquet(str(tmp_path / "in"))
    seen = []
    sink = summary_sink(lambda result, n: seen.extend(result.collect()))
    stream = spark.readStream.schema(RAW_TICK).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == ticker_summary(ticks).collect()


def test_landed_quotes_in_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    body = json.dumps({"results": {"p": 10.5, "s": 3}, "status": "OK"})
    lines = [{"seq": i, "ticker": "A", "body": body if i else "", "fetched_at": "2024-01-15T14:30:00Z"} for i in range(3)]
    (folder / "a.json").write_text("\n".join(json.dumps(line) for line in lines))
    batch = quotes_source_two(topics.read_quotes(spark, str(folder)))
    live = quotes_source_two(topics.read_quotes(spark, str(folder), stream=True))
    out = str(tmp_path / "out")
    sinks.to_files(live, out, str(tmp_path / "state"), drain=True).awaitTermination()
    rows = sorted(batch.collect(), key=lambda r: r["seq"])
    assert rows == sorted(spark.read.schema(live.schema).parquet(out).collect(), key=lambda r: r["seq"])
    assert [(r["price"], r["volume"], r["reject_reason"]) for r in rows][1:] == [(10.5, 3, None)] * 2
    assert rows[0]["reject_reason"] == "malformed_json"
