"""Correlation of candle returns between tickers.

Correlating every pair by a self-join would send each pair of each bucket through the shuffle.
Here tickers are grouped into blocks, and a task takes two blocks over a span of buckets, multiplies
their return matrices, and sends on the sums of each pair only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import duration
from .candles import candles

_SUMS = ("n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")


def candle_returns(ticks: DataFrame, width: str = "1h") -> DataFrame:
    """``(ticker, bucket, ret)``: change of the close from the ticker's previous candle."""
    bars = candles(ticks, width)
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("bucket"))
    returns = bars.select("ticker", "bucket", (F.try_divide(F.col("close"), before) - 1.0).alias("ret"))
    return returns.where(F.col("ret").isNotNull())


def correlation(
    ticks: DataFrame,
    width: str = "1h",
    tickers_per_block: int = 256,
    buckets_per_task: int = 4096,
    full: bool = False,
) -> DataFrame:
    """``(ticker_a, ticker_b, n, corr)`` over the buckets both tickers have; ``a < b`` unless ``full``.

    ``corr`` is NULL for fewer than two buckets, or where a ticker's returns do not vary over them: by less than
    the rounding of their sums can tell.
    """
    returns = candle_returns(ticks, width)
    everywhere = Window.partitionBy("ticker")
    # A shift does not change a correlation, and it keeps the sums of squares small.
    returns = returns.withColumn("ret", F.col("ret") - F.avg("ret").over(everywhere))
    tickers = ticks.where(F.col("ticker").isNotNull()).agg(F.approx_count_distinct("ticker")).first()[0]
    blocks = max(1, math.ceil(tickers / tickers_per_block))

    span = F.floor(F.unix_seconds("bucket") / _seconds(width) / buckets_per_task).cast("long")
    placed = returns.select(
        "ticker",
        F.unix_seconds("bucket").alias("bucket"),
        "ret",
        F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int").alias("block"),
        span.alias("span"),
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    paired = placed.withColumn("other", other).withColumns(
        {"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}
    ).drop("other")
    schema = "ticker_a STRING, ticker_b STRING, " + ", ".join(f"{name} DOUBLE" for name in _SUMS)
    sums = paired.groupBy("block_a", "block_b", "span").applyInPandas(_pair_sums, schema)
    sums = sums.groupBy("ticker_a", "ticker_b").agg(*[F.sum(name).alias(name) for name in _SUMS])
    n = F.col("n")
    cov = F.col("sum_ab") - F.col("sum_a") * F.col("sum_b") / n
    var_a = F.col("sum_aa") - F.col("sum_a") * F.col("sum_a") / n
    var_b = F.col("sum_bb") - F.col("sum_b") * F.col("sum_b") / n
    # Rounding leaves up to about n units in the last place of the sum of squares where nothing varies.
    noise = F.lit(4 * 2.0**-52) * n
    usable = (n >= 2) & (var_a > noise * F.col("sum_aa")) & (var_b > noise * F.col("sum_bb"))
    pairs = sums.select(
        "ticker_a",
        "ticker_b",
        n.cast("long").alias("n"),
        F.when(usable, F.try_divide(cov, F.sqrt(var_a * var_b))).alias("corr"),
    )
    if full:
        mirrored = F.explode(
            F.array(
                F.struct("ticker_a", "ticker_b"),
                F.struct(F.col("ticker_b").alias("ticker_a"), F.col("ticker_a").alias("ticker_b")),
            )
        )
        pairs = pairs.select(mirrored.alias("pair"), "n", "corr").select("pair.*", "n", "corr")
    return pairs


def _seconds(width: str) -> int:
    return int(duration(width).total_seconds())


def _matrix(frame: pd.DataFrame, buckets: pd.Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tickers, returns by bucket and ticker, 1.0 where there is a return)."""
    codes, tickers = pd.factorize(frame["ticker"], sort=True)
    rows = buckets.get_indexer(frame["bucket"])
    values, present = np.zeros((len(buckets), len(tickers))), np.zeros((len(buckets), len(tickers)))
    values[rows, codes] = frame["ret"].to_numpy()
    present[rows, codes] = 1.0
    return np.asarray(tickers, dtype=object), values, present


def _pair_sums(frame: pd.DataFrame) -> pd.DataFrame:
    block_a, block_b = frame["block_a"].iloc[0], frame["block_b"].iloc[0]
    buckets = pd.Index(frame["bucket"].unique())
    names_a, a, in_a = _matrix(frame[frame["block"] == block_a], buckets)
    names_b, b, in_b = _matrix(frame[frame["block"] == block_b], buckets)
    sums = {
        "n": in_a.T @ in_b,
        "sum_a": a.T @ in_b,
        "sum_b": in_a.T @ b,
        "sum_aa": (a * a).T @ in_b,
        "sum_bb": in_a.T @ (b * b),
        "sum_ab": a.T @ b,
    }
    if block_a == block_b:
        left, right = np.triu_indices(len(names_a), k=1)
    else:
        left, right = (index.ravel() for index in np.indices((len(names_a), len(names_b))))
    shared = sums["n"][left, right] > 0
    left, right = left[shared], right[shared]
    first, second = names_a[left], names_b[right]
    swap = first > second
    out = {"ticker_a": np.where(swap, second, first), "ticker_b": np.where(swap, first, second)}
    picked = {name: matrix[left, right] for name, matrix in sums.items()}
    for here, there in (("sum_a", "sum_b"), ("sum_aa", "sum_bb")):
        out[here] = np.where(swap, picked[there], picked[here])
        out[there] = np.where(swap, picked[here], picked[there])
    out["n"], out["sum_ab"] = picked["n"], picked["sum_ab"]
    return pd.DataFrame(out)[["ticker_a", "ticker_b", *_SUMS]]
