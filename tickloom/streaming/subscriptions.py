"""Subscription state of a stream of client actions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import TICK_ORDER

_FEED = "client_id STRING, seq BIGINT, tickers ARRAY<STRING>"
_HELD = "clients ARRAY<STRING>, tickers ARRAY<ARRAY<STRING>>"


def subscription_feed(log: DataFrame, buckets: int = 1024) -> DataFrame:
    """After each well-formed change of a connected client: the client and its full sorted list.

    Clients share ``buckets`` states by hash, because a call for every client costs far more than its few actions do.
    A micro-batch writes the states of the buckets with actions anew. The number belongs to the checkpoint.
    """
    dealt = log.withColumn("_bucket", F.pmod(F.xxhash64("client_id"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(_follow, _FEED, _HELD, "append", GroupStateTimeout.NoTimeout)


def _follow(key: tuple, frames: Iterable[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    """``clients`` are the connected ones of a bucket, ``held`` what each of them holds."""
    held = {client: set(tickers) for client, tickers in zip(*group.get)} if group.exists else {}
    changes = []
    batch = pd.concat(list(frames), ignore_index=True).sort_values(list(TICK_ORDER))
    for client, action, tickers, seq in zip(batch["client_id"], batch["action"], batch["tickers"], batch["seq"]):
        if action == "open":
            held[client] = set()
        elif action == "close":
            held.pop(client, None)
        elif client in held and action is not None and tickers is not None:
            if action == "subscribe":
                held[client] |= {ticker for ticker in tickers if ticker is not None}
            elif action == "unsubscribe":
                held[client] -= set(tickers)
            changes.append((client, seq, sorted(held[client])))
    if held:
        group.update((list(held), [sorted(tickers) for tickers in held.values()]))
    elif group.exists:
        group.remove()
    yield pd.DataFrame(changes, columns=["client_id", "seq", "tickers"])
