"""Splitting hot tickers.

An ordered window keeps one ticker in one task. That is fine until a ticker outgrows a task, so
tickers above a row limit are cut into consecutive pieces: Spark's range partitioner samples the
composite key (ticker, ts, seq) and spreads such a ticker over as many partitions as it needs,
whether its rows are crowded into one hour or one instant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HotSplit:
    """``max_pieces`` bounds what is broadcast; pieces grow beyond ``rows_per_piece`` if it binds."""

    rows_per_piece: int = 1_000_000
    max_pieces: int = 50_000


DEFAULT_SPLIT = HotSplit()


@dataclass(frozen=True)
class HotKeys:
    keys: DataFrame
    pieces: int


def find_hot(df: DataFrame, by: list[str], split: HotSplit) -> HotKeys | None:
    """Keys with more rows than one task should order, or None.

    The counts combine map-side. A hot key has more than total / max_pieces rows, so there are
    fewer than max_pieces hot keys whatever the input is, and listing them on the driver is safe.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    limit = max(split.rows_per_piece, math.ceil((total or 0) / split.max_pieces))
    if not largest or largest <= limit:
        return None
    hot = counts.where(F.col("_rows") > limit).collect()
    pieces = math.ceil(sum(row["_rows"] for row in hot) / limit)
    keys = df.sparkSession.createDataFrame([tuple(row)[:-1] for row in hot], df.select(*by).schema)
    return HotKeys(keys, pieces)


def divide(df: DataFrame, by: list[str], order: list[str], hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows of other keys, rows of hot keys with their ``_piece``).

    Piece numbers rise with the order inside a key. They come from a sampled partitioning, so the
    hot rows must be written once before they are read twice.
    """
    marker = F.broadcast(hot.keys.toDF(*[f"_hot_{name}" for name in by]))
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_hot_{name}")) for name in by])
    cold = df.join(marker, same, "left_anti")
    pieces = (
        df.join(marker, same, "left_semi")
        .repartitionByRange(hot.pieces, *by, *order)
        .withColumn("_piece", F.spark_partition_id())
    )
    return cold, pieces
