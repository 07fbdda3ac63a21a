
from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

import oracles
from tickloom.functions import columns as C
from tickloom.functions.stepper import IndicatorSpec
from tickloom.operators import normalize, reshape, retain, routing, summary, timelines, validate
from tickloom.operators.enrich import enrich, session_vwap, with_signals
from tickloom.operators.indicators import with_indicators
from tickloom.operators.pieces import HotSplit
from tickloom.plans import dashboard
from tickloom.plans.backtest import backtest
from tickloom.plans.candles import candles, daily_summary
from tickloom.plans.correlation import correlation
from tickloom.schema import INDICATOR_FIELDS
from tickloom.session import scratch_path
from tickloom.sources import fixtures, store, topics
from tickloom.sources.ticks import read_events, ticks_from_events
from tickloom.streaming import health, retained, sinks, subscription_table, subscriptions
from tickloom.streaming.enrich import enrich_stream
from tickloom.streaming.ordered import enrich_ordered, use_rocksdb, use_state_store
from tickloom.streaming.routed import route_stream

Query = Callable[[SparkSession, str], DataFrame]


def _ticks(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ticks_from_events(read_events(spark, folder))


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    return validate.valid_ticks(_ticks(spark, folder))


def _one_ticker(spark: SparkSession, folder: str) -> DataFrame:
    """All ticks under one ticker, the shape that must not end up in one task."""
    return _valid(spark, folder).withColumn("ticker", F.lit("HOT"))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.to_points(enrich(_ticks(spark, folder)))


def _out(df: DataFrame) -> DataFrame:
    """Comparable output: numbers rounded to six places, times without a zone, dates as text."""
    shown: list[Column] = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind == "double":
            column = C.rounded(column)
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind == "date":
            column = column.cast("string")
        shown.append(column.alias(name))
    return df.select(*shown)


def _flat(enriched: DataFrame) -> DataFrame:
    return enriched.select("seq", "ticker", "price", *[f"indicators.{name}" for name in INDICATOR_FIELDS], "indicators_ready")


def _indicator(spec: IndicatorSpec, *columns: str) -> Query:
    return lambda spark, folder: _out(with_indicators(_valid(spark, folder), spec).select("seq", "ticker", *columns))


# --- streams -------------------------------------------------------------------------------------


def _fed(spark: SparkSession, parts: list[DataFrame], start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Micro-batch by micro-batch: each part arrives and the stream goes on from its checkpoint until it is done."""
    path = scratch_path(spark, "arrivals")
    for part in parts:
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(part.schema).parquet(path)).awaitTermination()


def _stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks that arrive in disorder: those within the delay in their order, the others as rejects."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    before = use_rocksdb(spark)
    events = read_events(spark, folder)
    path = scratch_path(spark, "late")

    def start(arrived: DataFrame) -> StreamingQuery:
        rows = enrich_ordered(ticks_from_events(arrived), delay="6d")
        return sinks.to_files(rows, f"{path}/out", f"{path}/state", drain=True)

    _fed(spark, [*fixtures.arrivals(events, 4, disorder=True), fixtures.closing_event(events)], start)
    use_state_store(spark, before)
    done = spark.read.parquet(f"{path}/out").withColumn("late", F.col("reject_reason").isNotNull())
    return _out(done.select("seq", "ticker", "price", *[f"indicators.{name}" for name in INDICATOR_FIELDS], "indicators_ready", "late"))


def _streamed(spark: SparkSession, folder: str, start: Callable[[DataFrame], StreamingQuery], chunks: int = 3) -> None:
    """The ticks in several micro-batches, each handled by a stream that goes on from the last one's checkpoint."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _fed(spark, fixtures.arrivals(read_events(spark, folder), chunks), lambda arrived: start(ticks_from_events(arrived)))


def _drained(spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the ticks puts out, read back."""
    path = scratch_path(spark, "stream")
    _streamed(spark, folder, lambda ticks: sinks.to_files(build(ticks), f"{path}/out", f"{path}/state", drain=True))
    return spark.read.parquet(f"{path}/out")


def _stream_points(spark: SparkSession, folder: str, change: Callable[[DataFrame], DataFrame] = lambda ticks: ticks) -> DataFrame:
    path = scratch_path(spark, "stream")
    _streamed(
        spark, folder, lambda ticks: sinks.to_store(enrich_stream(change(ticks)), f"{path}/points", f"{path}/state", drain=True)
    )
    return _out(store.read_points(spark, f"{path}/points").drop("dt"))


def _stream_two_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Store and topic fed from one enriched stream; counts read back from both."""
    path = scratch_path(spark, "stream")

    def forward(batch: DataFrame, batch_id: int) -> None:
        normalize.to_messages(batch).write.mode("overwrite").parquet(f"{path}/topic/batch_id={batch_id}")

    _streamed(
        spark, folder, lambda ticks: sinks.to_store_and(enrich_stream(ticks), f"{path}/points", forward, f"{path}/state", drain=True)
    )
    stored = spark.read.parquet(f"{path}/points").groupBy("ticker").agg(F.count(F.lit(1)).alias("stored"))
    sent = spark.read.parquet(f"{path}/topic").groupBy(F.col("key").alias("ticker")).agg(F.count(F.lit(1)).alias("sent"))
    return stored.join(sent, "ticker", "full").select("ticker", "stored", "sent")


def _stream_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Raw topic to decoded ticks to enriched topic, read back as decoded ticks."""
    path = scratch_path(spark, "topics")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for part in fixtures.arrivals(read_events(spark, folder), 3):
        topics.publish(ticks_from_events(part).where(F.col("ticker").isNotNull()), f"{path}/raw", "parquet")
        raw = normalize.accepted(normalize.decode_messages(topics.read_topic(spark, [f"{path}/raw"], "parquet")))
        enriched = enrich_stream(raw.drop("raw", "indicators", "indicators_ready"))
        writer = topics.write_topic(enriched, f"{path}/processed", f"{path}/state", "parquet")
        writer.trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema(topics.MESSAGE).parquet(f"{path}/processed")
    return _out(_flat(normalize.accepted(normalize.decode_messages(back))))


def _stream_health(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over the persisted counters of all micro-batches, beside the rows that were written."""
    path = scratch_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        health.write_counters(batch, batch_id, f"{path}/counters")
        validate.valid_ticks(batch).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        batch.unpersist()

    def start(ticks: DataFrame) -> StreamingQuery:
        return ticks.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()

    _streamed(spark, folder, start, chunks=5)
    counters = health.read_counters(spark, f"{path}/counters")
    totals = counters.agg(F.count(F.lit(1)).alias("batches"), F.sum("ticks").alias("ticks"), F.sum("valid").alias("valid"))
    written = spark.read.parquet(f"{path}/out").agg(F.count(F.lit(1)).alias("points"))
    return totals.crossJoin(F.broadcast(written))


def _stream_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each micro-batch summarised by the function that its end calls; tickers carry the number of theirs."""
    path = scratch_path(spark, "summaries")

    def done(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    def start(ticks: DataFrame) -> StreamingQuery:
        stream = ticks.writeStream.foreachBatch(summary.summary_sink(done)).option("checkpointLocation", f"{path}/state")
        return stream.trigger(availableNow=True).start()

    _streamed(spark, folder, start)
    results = spark.read.parquet(f"{path}/out")
    return _out(results.withColumn("ticker", F.concat("batch_id", F.lit(":"), "ticker")).drop("batch_id"))


def _stream_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The subscription change feed; the newest list of each client that still has one."""
    log = _stored(_log(spark, folder), "log")
    path = scratch_path(spark, "stream")

    def start(actions: DataFrame) -> StreamingQuery:
        return sinks.to_files(subscriptions.subscription_feed(actions), f"{path}/out", f"{path}/state", drain=True)

    _fed(spark, fixtures.in_time_order(log, 3), start)
    return spark.read.parquet(f"{path}/out").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("changes"), F.array_join(F.max_by("tickers", "seq"), ",").alias("tickers")
    )


def _stream_subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """The subscription table that a stream of actions keeps, read at each of its versions."""
    log = _stored(_log(spark, folder), "log")
    path = scratch_path(spark, "subscriptions")

    def start(actions: DataFrame) -> StreamingQuery:
        writer = actions.writeStream.foreachBatch(subscription_table.upsert_sink(f"{path}/table", compact_every=2))
        return writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()

    _fed(spark, fixtures.in_time_order(log, 3), start)
    versions = [
        subscription_table.snapshot(spark, f"{path}/table", version).transform(routing.lists_of).withColumn("version", F.lit(version))
        for version in range(3)
    ]
    every = reduce(DataFrame.unionByName, versions)
    return every.select("version", "client_id", F.array_join("tickers", ",").alias("tickers"))


def _stream_routed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ticks routed to the clients of a subscription snapshot."""
    targets = _stored(routing.routes(fixtures.subscription_log(read_events(spark, folder))), "routes")

    def routed(ticks: DataFrame) -> DataFrame:
        return routing.route_ticks(validate.valid_ticks(ticks), targets).select("client_id", "ticker", "seq")

    return _per_client(_drained(spark, folder, routed))


def _stream_newest(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The newest ticks of each ticker as a stream keeps them, after its last micro-batch."""
    before = use_rocksdb(spark)
    rows = _drained(spark, folder, lambda ticks: retained.newest_stream(validate.valid_ticks(ticks), n))
    use_state_store(spark, before)
    return retained.kept_now(rows)


def _stream_routed_in_time(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks and actions as two streams that go on together; ticks to who held their ticker, or nothing, when they came."""
    log = _stored(_log(spark, folder), "log")
    path = scratch_path(spark, "routed")
    before = use_rocksdb(spark)
    for ticks, actions in fixtures.together_in_time([_valid(spark, folder), log], 3):
        ticks.write.mode("append").parquet(f"{path}/ticks")
        actions.write.mode("append").parquet(f"{path}/actions")
        routed = route_stream(
            spark.readStream.schema(ticks.schema).parquet(f"{path}/ticks"),
            spark.readStream.schema(actions.schema).parquet(f"{path}/actions"),
        )
        sinks.to_files(routed, f"{path}/out", f"{path}/state", drain=True).awaitTermination()
    use_state_store(spark, before)
    return _per_client(spark.read.parquet(f"{path}/out"))


# --- other compositions --------------------------------------------------------------------------


def _store_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Points written by date, then one ticker's last week read back."""
    path = scratch_path(spark, "points")
    store.write_points(enrich(_ticks(spark, folder)), path)
    points = store.read_points(spark, path)
    now = dashboard.just_after_latest(points)
    return _out(dashboard.indicator_history(points, "T3", "7d", now))


def _store_committed(spark: SparkSession, folder: str) -> DataFrame:
    """Points committed in three runs, one of them twice, and then put together."""
    enriched = _stored(enrich(_ticks(spark, folder)), "enriched")
    path = scratch_path(spark, "committed")
    for run in ("0", "1", "1", "2"):
        store.commit_points(enriched.where(F.pmod("seq", F.lit(3)) == int(run)), path, run)
    store.compact_points(spark, path, "together")
    return _out(store.read_committed(spark, path).drop("dt"))


def _dashboard(build: Callable[[DataFrame, Column], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        now = dashboard.just_after_latest(_valid(spark, folder))
        return _out(build(_points(spark, folder), now))

    return run


def _prices(build: Callable[[DataFrame, Column], DataFrame]) -> Query:
    """Questions about prices only: the points need no indicators, so none are computed."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        points = _valid(spark, folder)
        return _out(build(points, dashboard.just_after_latest(points)))

    return run


def _per_client(routed: DataFrame) -> DataFrame:
    return routed.groupBy("client_id", "ticker").agg(
        F.count(F.lit(1)).alias("ticks"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def _routed(spark: SparkSession, folder: str, broadcast_rows: int = routing.BROADCAST_ROWS) -> DataFrame:
    ticks = _valid(spark, folder)
    targets = _stored(routing.routes(fixtures.subscription_log(read_events(spark, folder))), "routes")
    return _per_client(routing.route_ticks(ticks, targets, broadcast_rows))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """A table that is used more than once, written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _routed_in_time(spark: SparkSession, folder: str, broadcast_rows: int = routing.BROADCAST_ROWS, rows_per_task: int = 1_000_000) -> DataFrame:
    """Ticks to the clients that held their ticker, or nothing, when they came."""
    timeline = _stored(timelines.timelines(_stored(_log(spark, folder), "log"), broadcast_rows), "timelines")
    ticks = _valid(spark, folder)
    return _per_client(timelines.route_in_time(ticks, timeline, broadcast_rows=broadcast_rows, rows_per_task=rows_per_task))


def _timelines(spark: SparkSession, folder: str) -> DataFrame:
    held = timelines.timelines(_stored(_log(spark, folder), "log"))
    # What still lasts has no end; as DOUBLE its number reads alike on both sides.
    return _out(
        held.select(
            "client_id",
            "ticker",
            F.col("since.ts").alias("since_ts"),
            F.col("since.seq").alias("since_seq"),
            F.col("until.ts").alias("until_ts"),
            F.col("until.seq").cast("double").alias("until_seq"),
        )
    )


def _log(spark: SparkSession, folder: str) -> DataFrame:
    _ticks(spark, folder)
    return fixtures.subscription_log(read_events(spark, folder))


def _counters(spark: SparkSession, folder: str) -> DataFrame:
    """Batch counters, filled in by the one pass that also writes the summaries."""
    observed, observation = summary.counted_batch(_ticks(spark, folder))
    observed.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    counted = observation.get
    names = ("ticks", "ticks_with_ticker", "ticks_valid")
    return spark.createDataFrame([tuple(int(counted[name]) for name in names)], ", ".join(f"{n} BIGINT" for n in names))


def _judged(judged: DataFrame) -> DataFrame:
    names = ("seq", "ticker", "price", "open", "high", "low", "volume", "ts", "source", "reject_reason")
    # A rejected row has no volume; as DOUBLE that reads alike on both sides.
    return _out(judged.select(*names).withColumn("volume", F.col("volume").cast("double")))


def _accepted_quotes(spark: SparkSession, folder: str) -> DataFrame:
    ticks = _ticks(spark, folder)
    first = normalize.accepted(normalize.quotes_source_one(fixtures.quotes_one(ticks)))
    second = normalize.accepted(normalize.quotes_source_two(fixtures.quotes_two(ticks)))
    return _out(normalize.one_relation(first, second))


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    known = with_signals(_ticks(spark, folder))
    return _out(known.select("seq", "ticker", "rsi_signal", "vwap_signal"))


def _change_and_range(spark: SparkSession, folder: str) -> DataFrame:
    """First and last price by a join of two relations, the literal form of the top-movers query."""
    points = _valid(spark, folder)
    rows = dashboard.within(points, "24h", dashboard.just_after_latest(points))
    both = dashboard.first_and_last(rows)
    first = both.select("ticker", "first_price")
    last = both.select("ticker", "last_price")
    joined = first.join(last, "ticker")
    return _out(joined.withColumn("change_pct", C.percent_change(F.col("first_price"), F.col("last_price"))))


def entry(spark: SparkSession) -> DataFrame:
    """Indicator history of one ticker over seven days."""
    folder = "/root/testdata/sf0.001"
    points = _points(spark, folder)
    return dashboard.indicator_history(points, "T3", "7d", dashboard.just_after_latest(_valid(spark, folder)))


def queries() -> dict[str, Query]:
    grid = IndicatorSpec(sma=(5, 10, 200), rsi=(1, 2, 7, 21), vwap=False)
    daily = IndicatorSpec(sma=(5,), rsi=(3,), reset_by=("day",))
    return {
        # validation and decoding
        "tick_validate": lambda s, d: _out(_valid(s, d)),
        "tick_rejects": lambda s, d: validate.rejected_ticks(_ticks(s, d)).select("seq", "reject_reason"),
        "tick_reject_counts": lambda s, d: validate.reject_counts(validate.rejected_ticks(_ticks(s, d))),
        "storable_ticks": lambda s, d: _out(validate.storable(_ticks(s, d)).select("seq", "ticker", "price")),
        "watchlist": lambda s, d: _out(validate.watch_only(_valid(s, d), ["T1", "T3", "T5"]).select("seq", "ticker", "price")),
        "decoded_messages": lambda s, d: _judged(normalize.decode_messages(fixtures.messages(_ticks(s, d)))),
        "quotes_source1": lambda s, d: _judged(normalize.quotes_source_one(fixtures.quotes_one(_ticks(s, d)))),
        "quotes_source2": lambda s, d: _judged(normalize.quotes_source_two(fixtures.quotes_two(_ticks(s, d)))),
        "quotes_source2_exchange": lambda s, d: _judged(
            normalize.quotes_source_two(fixtures.quotes_two(_ticks(s, d)), event_time="exchange")
        ),
        "ticks_union": _accepted_quotes,
        # indicators
        "sma_20": _indicator(IndicatorSpec(sma=(20,), rsi=(), vwap=False), "sma_20"),
        "sma_50": _indicator(IndicatorSpec(sma=(50,), rsi=(), vwap=False), "sma_50"),
        "rsi_14_zero": _indicator(IndicatorSpec(sma=(), rsi=(14,), vwap=False), "rsi_14"),
        "rsi_14_wilder": _indicator(IndicatorSpec(sma=(), rsi=(14,), vwap=False, rsi_seed="wilder"), "rsi_14"),
        "rsi_7_zero": _indicator(IndicatorSpec(sma=(), rsi=(7,), vwap=False), "rsi_7"),
        "vwap_running": _indicator(IndicatorSpec(sma=(), rsi=()), "vwap", "vwap_ready"),
        "vwap_daily": lambda s, d: _out(session_vwap(_ticks(s, d)).select("seq", "ticker", "vwap")),
        "vwap_total": lambda s, d: _out(summary.vwap_total(_ticks(s, d))),
        "daily_reset": lambda s, d: _out(
            with_indicators(_valid(s, d).withColumn("day", F.to_date("ts")), daily).select(
                "seq", "ticker", "tick_no", "sma_5", "rsi_3", "vwap"
            )
        ),
        "enriched_ticks": lambda s, d: _out(_flat(enrich(_ticks(s, d)))),
        "enriched_hot_ticker": lambda s, d: _out(
            _flat(enrich(_one_ticker(s, d), split=HotSplit(rows_per_piece=1500)))
        ),
        "indicator_grid": _indicator(grid, "tick_no", "sma_5", "sma_10", "sma_200", "rsi_1", "rsi_2", "rsi_7", "rsi_21"),
        "signals": _signals,
        # batch summary
        "ticker_summary": lambda s, d: _out(summary.ticker_summary(_ticks(s, d))),
        "ticker_summary_hot": lambda s, d: _out(summary.ticker_summary(_one_ticker(s, d), span="3h")),
        "batch_counters": _counters,
        # stored points
        "stored_raw_points": lambda s, d: _out(reshape.to_points(_ticks(s, d))),
        "stored_points": lambda s, d: _out(_points(s, d)),
        "dirty_numbers": lambda s, d: _out(reshape.to_points(fixtures.dirty(_ticks(s, d)))),
        "dirty_rejects": lambda s, d: validate.unstorable(fixtures.dirty(_ticks(s, d))).select("seq", "reject_reason"),
        "dirty_points": lambda s, d: _out(reshape.to_points(enrich(fixtures.dirty(_ticks(s, d))))),
        "points_long": lambda s, d: _out(reshape.to_long(_points(s, d))),
        "points_wide": lambda s, d: _out(reshape.to_wide(reshape.to_long(_points(s, d)))),
        "store_scan": _store_scan,
        "store_committed": _store_committed,
        # dashboard
        "latest_tick": _dashboard(lambda p, now: dashboard.latest_tick(p, "T3", now)),
        "price_history": _prices(lambda p, now: dashboard.price_history(p, "T3", "24h", now)),
        "indicator_history": _dashboard(lambda p, now: dashboard.indicator_history(p, "T3", "7d", now)),
        "top_movers": _prices(lambda p, now: dashboard.top_movers(p, 5, "24h", now)),
        "top_movers_abs": _prices(lambda p, now: dashboard.top_movers(p, 5, "24h", now, by="abs")),
        "top_movers_per_source": _prices(lambda p, now: dashboard.top_movers(p, 7, "24h", now, per_source=True)),
        "first_last_join": _change_and_range,
        "market_summary": _prices(lambda p, now: dashboard.market_summary(p, now)),
        "market_summary_per_source": _prices(lambda p, now: dashboard.market_summary(p, now, "24h", per_source=True)),
        # bounded takes
        "newest_n": lambda s, d: _out(retain.newest_n(_valid(s, d), 25).select("seq", "ticker", "price")),
        "newest_overall": lambda s, d: _out(retain.newest_n(_valid(s, d), 100, per_ticker=False).select("seq", "price")),
        "oldest_n": lambda s, d: _out(retain.oldest_n(_valid(s, d), 500).select("seq", "price")),
        "overwritten": lambda s, d: retain.overwritten(_valid(s, d), 100),
        # clients
        "known_actions": lambda s, d: routing.known_actions(_log(s, d)).select("client_id", "action", "seq"),
        "known_actions_salted": lambda s, d: routing.known_actions(_log(s, d), 0).select("client_id", "action", "seq"),
        "subscription_state": lambda s, d: routing.subscriptions(_log(s, d)),
        "subscription_lists": lambda s, d: routing.subscription_lists(_log(s, d)).select(
            "client_id", F.array_join("tickers", ",").alias("tickers")
        ),
        "subscription_timelines": _timelines,
        "routed_ticks": _routed_in_time,
        "routed_ticks_salted": lambda s, d: _routed_in_time(s, d, broadcast_rows=0, rows_per_task=10),
        "routed_by_final_sets": _routed,
        "routed_by_final_sets_salted": lambda s, d: _routed(s, d, broadcast_rows=0),
        # batch workloads
        "candles_1h": lambda s, d: _out(candles(_ticks(s, d), "1h")),
        "candles_1m": lambda s, d: _out(candles(_ticks(s, d), "1m")),
        "daily_summary": lambda s, d: _out(daily_summary(_ticks(s, d))),
        "correlation": lambda s, d: _out(correlation(_ticks(s, d), "1h")),
        "correlation_flat": lambda s, d: _out(correlation(fixtures.half_flat(_ticks(s, d)), "1h", 3, 100)),
        "correlation_blocks": lambda s, d: _out(correlation(_ticks(s, d), "1h", 3, 100, full=True)),
        "backtest": lambda s, d: _out(backtest(_ticks(s, d))),
        "backtest_hot": lambda s, d: _out(backtest(_one_ticker(s, d), split=HotSplit(rows_per_piece=1500))),
        # streams
        "stream_enriched": lambda s, d: _out(_flat(_drained(s, d, enrich_stream))),
        "stream_late": _stream_late,
        "stream_candles": lambda s, d: _out(_drained(s, d, lambda ticks: candles(ticks, "1h", late="1h"))),
        "stream_points": _stream_points,
        "stream_dirty_points": lambda s, d: _stream_points(s, d, fixtures.dirty),
        "stream_two_sinks": _stream_two_sinks,
        "stream_topics": _stream_topics,
        "stream_health": _stream_health,
        "stream_summary": _stream_summary,
        "stream_feed": _stream_feed,
        "stream_subscriptions": _stream_subscriptions,
        "stream_routed": _stream_routed,
        "stream_routed_in_time": _stream_routed_in_time,
        "stream_newest_n": lambda s, d: _out(_stream_newest(s, d, 25).select("seq", "ticker", "price")),
        "stream_overwritten": lambda s, d: _stream_newest(s, d, 100).select("ticker", "overwritten").distinct(),
    } | _corpus_queries()


def _installed(module: str) -> bool:
    """Whether the module has code; a folder left without any does not count."""
    spec = importlib.util.find_spec(module)
    return spec is not None and spec.origin is not None


def _corpus_queries() -> dict[str, Query]:
    """Queries of the training-data operators and of the pipeline made of them, where that subpackage is installed."""
    found: dict[str, Query] = {}
    if _installed("tickloom.llm"):
        from tickloom.llm import queries as corpus

        found |= corpus.queries()
        if _installed("corpus_pipeline"):
            import corpus_pipeline

            found["pipeline"] = corpus_pipeline.run
    return found


def _corpus_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    if _installed("tickloom.llm"):
        from tickloom.llm import queries as corpus

        found |= corpus.oracle_sql()
        if _installed("corpus_pipeline"):
            import corpus_pipeline

            if corpus_pipeline.ORACLE_SQL is not None:
                found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def oracle_sql() -> dict[str, str]:
    return oracles.sql() | _corpus_sql()
