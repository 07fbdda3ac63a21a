from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest

from tickloom.schema import RAW_TICK
from tickloom.session import build_session

START = datetime(2024, 1, 15, 14, 30, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_ticks(spark):
    """Ticks from ``(ticker, price)`` pairs, one second apart, high and low one percent around."""

    def make(pairs, **overrides):
        rows = []
        for i, (ticker, price) in enumerate(pairs):
            row = {
                "seq": i,
                "ticker": ticker,
                "price": price,
                "open": price,
                "high": None if price is None else price * 1.01,
                "low": None if price is None else price * 0.99,
                "volume": 100_000,
                "ts": START + timedelta(seconds=i),
                "source": "alpha_vantage",
            }
            row |= {name: value(i) if callable(value) else value for name, value in overrides.items()}
            rows.append(tuple(row[name] for name in RAW_TICK.fieldNames()))
        return spark.createDataFrame(rows, RAW_TICK)

    return make
