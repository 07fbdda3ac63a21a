from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns as C
from tickloom.operators import normalize as N
from tickloom.operators import validate as V

from .conftest import START

QUOTE = {"01. symbol": "AAPL", "02. open": "180.5", "03. high": "183", "04. low": "179", "05. price": "182.63", "06. volume": "51234567"}


def landed(spark, bodies):
    rows = [(i, "AAPL", body if body is None or isinstance(body, str) else json.dumps(body), START) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "seq BIGINT, ticker STRING, body STRING, fetched_at TIMESTAMP")


def reasons(df):
    return [row["reject_reason"] for row in df.orderBy("seq").collect()]


def test_source_one(spark):
    without = {k: v for k, v in QUOTE.items() if k != "03. high"}
    bodies = [
        {"Global Quote": QUOTE},
        {"Note": "limit"},
        {"Information": "limit"},
        {"Other": 1},
        {"Global Quote": without},
        {"Global Quote": QUOTE | {"05. price": "abc"}},
        {"Global Quote": QUOTE | {"05. price": "1.5abc"}},
        {"Global Quote": QUOTE | {"05. price": "nan"}},
        {"Global Quote": QUOTE | {"06. volume": None}},
        "not json",
        "",
        None,
        "[1]",
        "123",
    ]
    judged = N.quotes_source_one(landed(spark, bodies))
    assert reasons(judged) == [
        None,
        "rate_limited",
        "rate_limited",
        "missing_quote",
        "missing_field:03. high",
        "bad_number:05. price",
        "bad_number:05. price",
        "bad_number:05. price",
        "bad_number:06. volume",
        *["malformed_json"] * 5,
    ]
    good = N.accepted(judged).collect()
    assert [tuple(good[0][n] for n in ("ticker", "price", "open", "high", "low", "volume", "source"))] == [
        ("AAPL", 182.63, 180.5, 183.0, 179.0, 51234567, "alpha_vantage")
    ]
    assert N.accepted(judged).count() + N.rejected(judged).count() == len(bodies)


def test_source_two(spark):
    trade = {"p": 182.63, "s": 100, "t": 1705329000000}
    bodies = [
        {"results": trade, "status": "OK"},
        {"results": {}, "status": "OK"},
        {"results": trade, "status": "ERROR"},
        {"status": "OK"},
        {"results": trade},
        {"results": {"p": "182"}, "status": "OK"},
        "{",
    ]
    judged = N.quotes_source_two(landed(spark, bodies))
    assert reasons(judged) == [None, None, "bad_status", "missing_results", "missing_results", "malformed_json", "malformed_json"]
    first, second = N.accepted(judged).orderBy("seq").collect()
    assert (first["price"], first["open"], first["high"], first["low"], first["volume"]) == (182.63,) * 4 + (100,)
    assert (second["price"], second["volume"]) == (0.0, 0)
    exchange = N.accepted(N.quotes_source_two(landed(spark, bodies), "exchange")).orderBy("seq")
    assert [r[0] for r in exchange.select(F.unix_millis("ts")).collect()] == [1705329000000, int(START.timestamp() * 1000)]
    with pytest.raises(ValueError):
        N.quotes_source_two(landed(spark, bodies), "other")


def messages(spark, payloads, key="AAPL"):
    rows = [(i, key, payload if payload is None or isinstance(payload, str) else json.dumps(payload), START) for i, payload in enumerate(payloads)]
    return spark.createDataFrame(rows, "seq BIGINT, key STRING, value STRING, ts TIMESTAMP")


def test_messages(spark):
    tick = {"ticker": "X", "price": 10.0, "open": 9.0, "high": 11.0, "low": 8.0, "volume": 5, "timestamp": "2024-01-15T14:30:07Z", "source": "massive"}
    payloads = [
        tick,
        tick | {"volume": 5.0, "extra": [1]},
        {"price": 10.0},
        {"price": 0.0},
        {"price": None},
        {},
        {"price": "1.5"},
        "{ not valid json }",
        "",
        None,
        "123",
        "[1]",
    ]
    judged = N.decode_messages(messages(spark, payloads))
    assert reasons(judged) == [None] * 3 + ["invalid_price"] * 3 + ["malformed_json"] * 6
    rows = judged.orderBy("seq").collect()
    # The key names the ticker; an unknown field stays in the raw text.
    assert rows[0]["ticker"] == "AAPL" and rows[0]["ts"].second == 7
    assert rows[1]["volume"] == 5 and "extra" in rows[1]["raw"]
    assert (rows[2]["open"], rows[2]["volume"], rows[2]["source"]) == (0.0, 0, "unknown")
    assert {r["ticker"] for r in N.decode_messages(messages(spark, [tick], None)).collect()} == {"unknown"}


def test_message_round_trip(make_ticks, spark):
    from tickloom.operators.enrich import enrich

    enriched = enrich(make_ticks([("A", 100.0 + i / 3) for i in range(55)]))
    back = N.accepted(N.decode_messages(N.to_messages(enriched, keep=("seq", "ts"))))
    sent = enriched.orderBy("seq").collect()
    for a, b in zip(sent, back.orderBy("seq").collect()):
        assert (a["price"], a["indicators"], a["indicators_ready"], a["ts"]) == (b["price"], b["indicators"], b["indicators_ready"], b["ts"])


def test_good_and_rejected_are_all(make_ticks):
    ticks = make_ticks([("A", 1.0), (None, 1.0), ("A", 0.0), ("A", None), (None, None), ("A", float("inf"))])
    good, bad = V.valid_ticks(ticks), V.rejected_ticks(ticks)
    assert good.count() + bad.count() == ticks.count()
    assert {r["reject_reason"]: r["n"] for r in V.reject_counts(bad).collect()} == {"missing_ticker": 2, "invalid_price": 3}
    # An infinite price is no number to store; a price of zero is.
    assert V.storable(ticks).count() == 2 and V.unstorable(ticks).count() == 4


def test_watch_list_by_names_and_by_relation(make_ticks, spark):
    ticks = make_ticks([("A", 1.0), ("B", 1.0), ("C", 1.0), ("A", 2.0)])
    watch = spark.createDataFrame([("A",), ("A",), ("B",)], "ticker STRING")
    assert V.watch_only(ticks, ["A", "B"]).count() == V.watch_only(ticks, watch).count() == 3


def test_durations():
    assert [C.duration(t).total_seconds() for t in ("30s", "5m", "1h", "24h", "7d", "2w")] == [30, 300, 3600, 86400, 604800, 1209600]
    for bad in ("", "h", "0h", "1y", "-1h", "1h2m"):
        with pytest.raises(ValueError):
            C.duration(bad)


@pytest.mark.parametrize("judge", [N.quotes_source_one, N.quotes_source_two, lambda rows: N.decode_messages(rows.selectExpr("seq", "ticker AS key", "body AS value", "fetched_at AS ts"))])
def test_a_condition_on_parsed_rows_does_not_parse_them_again(spark, judge):
    plan = V.valid_ticks(N.accepted(judge(landed(spark, [{}, None]))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2
