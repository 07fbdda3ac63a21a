"""One row per ticker of a batch of ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.stepper import DEFAULT_SPEC
from ..schema import INDICATOR_FIELDS
from .enrich import READY_AT
from .folded import final_indicators
from .validate import fill_defaults, tick_reason, valid_ticks


def ticker_summary(ticks: DataFrame, span: str = "1d") -> DataFrame:
    """Last price, final indicators and tick count per ticker.

    The count includes invalid ticks, and a ticker with invalid ticks only keeps its row of zeros. One scan and one
    shuffle of ticks, by ticker and ``span`` of time; ``span`` should hold what a task sorts comfortably.
    """
    if ticks.isStreaming:
        raise ValueError("summarise a stream by micro-batch: use summary_sink")
    named = ticks.where(F.col("ticker").isNotNull())
    final = final_indicators(fill_defaults(named), tick_reason().isNull(), DEFAULT_SPEC, span)
    return final.select(
        "ticker",
        "last_price",
        *INDICATOR_FIELDS,
        F.col("ticks").alias("tick_count"),
        (F.col("seen") >= READY_AT).alias("indicators_ready"),
    )


def vwap_total(ticks: DataFrame) -> DataFrame:
    """VWAP of all counted ticks per ticker: sums only, so no order and no shuffle of rows."""
    price, high, low, volume = (F.col(name) for name in ("price", "high", "low", "volume"))
    counted = valid_ticks(ticks).where(C.counts_for_vwap(price, high, low, volume))
    return counted.groupBy("ticker").agg(
        F.try_divide(F.sum(C.typical_price(price, high, low) * volume), F.sum(volume.cast("double"))).alias("vwap")
    )


def counted_batch(ticks: DataFrame, name: str = "batch") -> tuple[DataFrame, Observation]:
    """The batch with counters attached: all rows, rows with a ticker, valid rows.

    The counters are filled in by whichever action runs the batch, without a second pass.
    """
    observation = Observation(name)
    observed = ticks.observe(
        observation,
        F.count(F.lit(1)).alias("ticks"),
        F.count("ticker").alias("ticks_with_ticker"),
        F.count(F.when(tick_reason().isNull(), 1)).alias("ticks_valid"),
    )
    return observed, observation


def summary_sink(done: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each micro-batch's summary to ``done``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        done(ticker_summary(batch), batch_id)

    return run
