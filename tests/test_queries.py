"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

from .compare import check, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


#: Queries of the training-data subpackage have their own tests.
OWN = sorted(set(entry.queries()) - set(entry._corpus_queries()))


def test_every_query_has_sql():
    assert set(OWN) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    verdict = check(spark, con, name, entry.queries()[name], SQL[name], FOLDER)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["ts", "seq", "sma_20", "sma_50", "rsi_14", "vwap"]
    assert result.count() > 0
