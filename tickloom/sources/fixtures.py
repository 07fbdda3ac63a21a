"""Relations derived from the ``events`` table for checks and demonstrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.normalize import QUOTE_FIELDS
from ..schema import SOURCE_ONE, SOURCE_TWO


def messages(ticks: DataFrame) -> DataFrame:
    """Every tick as a topic message, some of them damaged."""
    seq = F.col("seq")
    fields = F.struct(
        "price", "open", "high", "low", "volume", C.iso_text(F.col("ts")).alias("timestamp"), "source"
    )
    text_price = F.struct(F.col("price").cast("string").alias("price"), "volume")
    real_volume = F.struct("price", (F.col("volume") + F.lit(0.5)).alias("volume"))
    value = (
        F.when(seq % 89 == 0, F.lit("{ not valid json }"))
        .when(seq % 83 == 0, F.lit(""))
        .when(seq % 79 == 0, F.lit("[1]"))
        .when(seq % 73 == 0, F.to_json(text_price))
        .when(seq % 71 == 0, F.to_json(real_volume))
        .otherwise(F.to_json(fields))
    )
    return ticks.select("seq", F.col("ticker").alias("key"), value.alias("value"), "ts")


def quotes_one(ticks: DataFrame) -> DataFrame:
    """Quote documents of the first source, some of them notices, incomplete or damaged."""
    seq = F.col("seq")
    numbers = {name: F.col(name).cast("string") for name in QUOTE_FIELDS}
    numbers["price"] = F.when(seq % 79 == 0, F.lit("n/a")).otherwise(numbers["price"])
    numbers["high"] = F.when(seq % 83 != 0, numbers["high"])
    quote = F.struct(*[numbers[name].alias(field) for name, field in QUOTE_FIELDS.items()])
    body = (
        F.when(seq % 89 == 0, F.to_json(F.struct(F.lit("call limit reached").alias("Note"))))
        .when(seq % 73 == 0, F.lit("<html>"))
        .otherwise(F.to_json(F.struct(quote.alias("Global Quote"))))
    )
    return _landed(ticks.where(F.col("source") == SOURCE_ONE), body)


def quotes_two(ticks: DataFrame) -> DataFrame:
    """Last-trade documents of the second source, some with another status or without results."""
    seq = F.col("seq")
    trade = F.struct(
        F.col("price").alias("p"),
        F.when(seq % 79 != 0, F.col("volume")).alias("s"),
        F.when(seq % 7 != 0, F.unix_millis("ts")).alias("t"),
    )
    status = F.when(seq % 89 == 0, F.lit("ERROR")).otherwise(F.lit("OK"))
    body = F.when(seq % 83 == 0, F.to_json(F.struct(status.alias("status")))).otherwise(
        F.to_json(F.struct(trade.alias("results"), status.alias("status")))
    )
    return _landed(ticks.where(F.col("source") == SOURCE_TWO), body)


def _landed(ticks: DataFrame, body: Column) -> DataFrame:
    """Fetched a minute after the trade."""
    return ticks.select("seq", "ticker", body.alias("body"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("fetched_at"))


def subscription_log(events: DataFrame) -> DataFrame:
    """Client actions: each user is a client whose every event changes two tickers.

    Clients open a second before their first event; some close at the end, and two never ask for
    anything. A few actions are malformed, and one client acts without having connected.
    """
    number, symbol = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    ts = F.col("ts").cast("timestamp")
    client = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    asks = F.col("event_type").isin("view", "purchase", "signup")
    changes = events.select(
        client.alias("client_id"),
        F.when(number % 97 != 0, F.when(asks, F.lit("subscribe")).otherwise(F.lit("unsubscribe"))).alias("action"),
        F.when(
            number % 89 != 0,
            F.array(
                F.concat(F.lit("T"), (symbol % 10).cast("string")),
                F.concat(F.lit("T"), (number % 10).cast("string")),
            ),
        ).alias("tickers"),
        ts.alias("ts"),
        number.alias("seq"),
    )
    none = F.lit(None).cast("array<string>")
    second = F.expr("INTERVAL 1 SECOND")
    users = events.where(F.col("user_id") != 5).groupBy("user_id").agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    opens = users.select(
        client.alias("client_id"), F.lit("open").alias("action"), none.alias("tickers"), (F.col("first") - second).alias("ts"), F.lit(-1).cast("long").alias("seq")
    )
    closes = users.where(F.col("user_id") % 7 == 3).select(
        client.alias("client_id"), F.lit("close").alias("action"), none.alias("tickers"), (F.col("last") + second).alias("ts"), F.lit(-2).cast("long").alias("seq")
    )
    quiet = events.agg(F.min(ts).alias("ts")).select(
        F.explode(F.array(F.lit("w0"), F.lit("w1"))).alias("client_id"), F.lit("open").alias("action"), none.alias("tickers"), "ts", F.lit(-1).cast("long").alias("seq")
    )
    return changes.unionByName(opens).unionByName(closes).unionByName(quiet)


def arrivals(events: DataFrame, chunks: int, disorder: bool = False) -> list[DataFrame]:
    """The events as they come in, in ``chunks`` of equally many event numbers.

    With ``disorder`` one event in eleven comes a seventh of the table later than its number says, and another one
    half of the table later.
    """
    total = events.agg(F.max("event_id")).first()[0] + 1
    number = F.col("event_id")
    place = number
    if disorder:
        place = number + F.when(number % 11 == 3, total // 7).when(number % 11 == 7, total // 2).otherwise(0)
    chunk = F.least(F.floor(place * chunks / total), F.lit(chunks - 1))
    return [events.where(chunk == i) for i in range(chunks)]


def closing_event(events: DataFrame) -> DataFrame:
    """One event of a user of its own, a year after the last, that lets everything before it go."""
    last = events.agg(F.max("ts").alias("ts"))
    return last.select(
        F.lit(1).cast("long").alias("event_id"),
        (F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"),
        F.lit(-1).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"),
        F.lit('{"k": 1}').alias("props"),
    )


def in_time_order(rows: DataFrame, chunks: int) -> list[DataFrame]:
    """Rows in ``chunks`` of equally long spans of ``ts``."""
    return [part for (part,) in together_in_time([rows], chunks)]


def together_in_time(tables: list[DataFrame], chunks: int) -> list[list[DataFrame]]:
    """Tables cut at the same moments into ``chunks`` of equally long spans of ``ts``; one list a span."""
    micros = F.unix_micros("ts")
    ends = [table.agg(F.min(micros), F.max(micros)).first() for table in tables]
    low, high = min(lo for lo, _ in ends), max(hi for _, hi in ends)
    chunk = F.floor((micros - F.lit(low)) * F.lit(chunks) / F.lit(high - low + 1))
    return [[table.where(chunk == i) for table in tables] for i in range(chunks)]


def dirty(ticks: DataFrame) -> DataFrame:
    """Ticks with numbers that are missing or not finite among their prices."""
    seq = F.col("seq")
    nan, up, down = (F.lit(float(name)) for name in ("nan", "inf", "-inf"))
    return ticks.withColumns(
        {
            "price": F.when(seq % 13 == 0, nan).when(seq % 17 == 0, up).when(seq % 19 == 0, down).otherwise(F.col("price")),
            "open": F.when(seq % 31 != 0, F.col("open")),
            "high": F.when(seq % 23 == 0, nan).when(seq % 37 == 0, up).otherwise(F.col("high")),
            "low": F.when(seq % 29 == 0, down).otherwise(F.col("low")),
        }
    )


def half_flat(ticks: DataFrame) -> DataFrame:
    """T1 stands still in its second half, and T2 trades only while T1 does."""
    total = ticks.agg(F.max("seq")).first()[0] + 1
    seq, ticker = F.col("seq"), F.col("ticker")
    still = (ticker == "T1") & (seq * 2 >= total)
    away = (ticker == "T2") & (seq * 10 < total * 6)
    return ticks.where(F.coalesce(~away, F.lit(True))).withColumn("price", F.when(still & (F.col("price") > 0), 100.0).otherwise(F.col("price")))
