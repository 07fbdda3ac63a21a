"""Quote documents and tick messages to ticks.

Every function returns all of its input rows with a ``reject_reason``; :func:`accepted` and
:func:`rejected` divide them, so nothing is lost in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import RAW_TICK, SOURCE_ONE, SOURCE_TWO, TICK_MESSAGE, UNKNOWN
from .validate import REJECT

_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}

# The fields of the first source's quote.
QUOTE_FIELDS = {
    "price": "05. price",
    "open": "02. open",
    "high": "03. high",
    "low": "04. low",
    "volume": "06. volume",
}
_QUOTE_DOCUMENT = "`Global Quote` MAP<STRING, STRING>, Note STRING, Information STRING, _corrupt STRING"
_TRADE_DOCUMENT = "results STRUCT<p: DOUBLE, s: DOUBLE, t: BIGINT>, status STRING, _corrupt STRING"


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col(REJECT).isNull()).drop(REJECT)


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col(REJECT).isNotNull())


def _parsed(rows: DataFrame, text: Column, document: T.StructType | str) -> DataFrame:
    """``rows`` with the JSON ``text`` as ``_doc``, in a step of its own.

    A later condition on parsed fields would else be moved before the parsing, which then runs anew for each mention.
    """
    return rows.select("*", F.explode(F.array(F.from_json(text, document, _JSON))).alias("_doc"))


def _unreadable(text: Column, parsed: Column) -> Column:
    """Malformed JSON, a scalar or an array fill the corrupt column; empty text gives no struct at all."""
    return text.isNull() | (F.trim(text) == "") | parsed.isNull() | parsed["_corrupt"].isNotNull()


def _finite(number: Column) -> Column:
    return F.when(F.abs(number) < float("inf"), number)


def quotes_source_one(landed: DataFrame) -> DataFrame:
    """Quotes whose numbers are text, from ``(seq, ticker, body, fetched_at)``."""
    body = F.col("body")
    rows = _parsed(landed, body, _QUOTE_DOCUMENT)
    doc, quote = F.col("_doc"), F.col("_doc")["Global Quote"]
    values = {name: _finite(quote[field].try_cast("double")) for name, field in QUOTE_FIELDS.items()}
    values["volume"] = quote[QUOTE_FIELDS["volume"]].try_cast("bigint")

    reason = F.when(_unreadable(body, doc), F.lit("malformed_json"))
    reason = reason.when(doc["Note"].isNotNull() | doc["Information"].isNotNull(), F.lit("rate_limited"))
    reason = reason.when(quote.isNull(), F.lit("missing_quote"))
    for field in QUOTE_FIELDS.values():
        reason = reason.when(~F.map_contains_key(quote, field), F.lit(f"missing_field:{field}"))
    for name, field in QUOTE_FIELDS.items():
        reason = reason.when(values[name].isNull(), F.lit(f"bad_number:{field}"))
    return _ticks(rows, values, F.col("fetched_at"), SOURCE_ONE, reason)


def quotes_source_two(landed: DataFrame, event_time: str = "fetch") -> DataFrame:
    """Last trades, from ``(seq, ticker, body, fetched_at)``; a trade's price is its open, high and low.

    ``event_time="exchange"`` takes the trade's own time where it is present.
    """
    if event_time not in ("fetch", "exchange"):
        raise ValueError(f"unknown event_time {event_time!r}")
    body = F.col("body")
    rows = _parsed(landed, body, _TRADE_DOCUMENT)
    doc, trade = F.col("_doc"), F.col("_doc")["results"]
    price = C.number_or(trade["p"])
    values = {name: price for name in ("price", "open", "high", "low")}
    values["volume"] = F.coalesce(trade["s"].try_cast("bigint"), F.lit(0).cast("long"))
    time = F.col("fetched_at")
    if event_time == "exchange":
        time = F.coalesce(F.timestamp_millis(trade["t"]), time)

    reason = F.when(_unreadable(body, doc), F.lit("malformed_json"))
    reason = reason.when(trade.isNull() | doc["status"].isNull(), F.lit("missing_results"))
    reason = reason.when(doc["status"] != "OK", F.lit("bad_status"))
    reason = reason.when(trade["p"].isNotNull() & ~C.is_finite(trade["p"]), F.lit("bad_number:p"))
    return _ticks(rows, values, time, SOURCE_TWO, reason)


def _ticks(rows: DataFrame, values: dict[str, Column], time: Column, source: str, reason: Column) -> DataFrame:
    return rows.select(
        "seq",
        "ticker",
        *[values[name].alias(name) for name in ("price", "open", "high", "low", "volume")],
        time.alias("ts"),
        F.lit(source).alias("source"),
        reason.alias(REJECT),
    )


def one_relation(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources as one tick relation."""
    names = RAW_TICK.fieldNames()
    return first.select(*names).unionByName(second.select(*names))


def decode_messages(messages: DataFrame) -> DataFrame:
    """Ticks from topic rows ``(seq, key, value, ts)``.

    The key names the ticker ('unknown' without one). ``raw`` keeps the payload, so fields outside
    the schema stay available.
    """
    text = F.col("value").cast("string")
    document = T.StructType([*TICK_MESSAGE.fields, T.StructField("_corrupt", T.StringType())])
    rows = _parsed(messages, text, document)
    malformed = _unreadable(text, F.col("_doc"))
    rows = rows.withColumn("_bad", malformed).withColumn("_doc", F.when(~F.col("_bad"), F.col("_doc")))
    doc, known = F.col("_doc"), ~F.col("_bad")
    reason = F.when(F.col("_bad"), F.lit("malformed_json")).when(
        ~C.is_valid_price(doc["price"]), F.lit("invalid_price")
    )
    return rows.select(
        "seq",
        F.coalesce(F.col("key").cast("string"), F.lit(UNKNOWN)).alias("ticker"),
        *[F.when(known, C.number_or(doc[name])).alias(name) for name in ("price", "open", "high", "low")],
        F.when(known, F.coalesce(doc["volume"].try_cast("bigint"), F.lit(0).cast("long"))).alias("volume"),
        F.coalesce(C.iso_timestamp(doc["timestamp"]), F.col("ts")).alias("ts"),
        F.coalesce(doc["source"], F.lit(UNKNOWN)).alias("source"),
        doc["indicators"].alias("indicators"),
        F.coalesce(doc["indicators_ready"], F.lit(False)).alias("indicators_ready"),
        text.alias("raw"),
        reason.alias(REJECT),
    )


def to_messages(ticks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Topic rows ``(key, value)``: the ticker, and the tick as JSON with its time as text.

    ``keep`` names columns to carry beside them, for topics that number no offsets themselves.
    """
    extra = [name for name in ("indicators", "indicators_ready") if name in ticks.columns]
    names = ("ticker", "price", "open", "high", "low", "volume")
    value = F.struct(*names, C.iso_text(F.col("ts")).alias("timestamp"), "source", *extra)
    return ticks.select(F.col("ticker").alias("key"), F.to_json(value).alias("value"), *keep)
