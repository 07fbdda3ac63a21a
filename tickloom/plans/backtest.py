"""Indicator rules tried over history, many parameters in one pass.

A rule's position at a tick uses that tick's indicators and earns the return to the next tick, so no
rule sees the price it trades on ahead of time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stepper import IndicatorSpec
from ..operators.indicators import rsi_ready, sma_ready, with_indicators
from ..operators.pieces import DEFAULT_SPLIT, HotSplit
from ..operators.validate import valid_ticks


_ROUNDING = 1e-10


@dataclass(frozen=True)
class Crossover:
    """Long while the fast average is above the slow one."""

    fast: int
    slow: int

    @property
    def name(self) -> str:
        return f"sma_{self.fast}_{self.slow}"

    def position(self) -> Column:
        # Equal averages may differ in their last digits, and equal is not above.
        fast, slow = F.col(f"sma_{self.fast}"), F.col(f"sma_{self.slow}")
        above = fast - slow > slow * _ROUNDING
        return F.when(sma_ready(max(self.fast, self.slow)) & above, F.lit(1)).otherwise(F.lit(0))


@dataclass(frozen=True)
class RsiBand:
    """Long below ``low``, short above ``high``, otherwise out."""

    period: int
    low: float = 30.0
    high: float = 70.0

    @property
    def name(self) -> str:
        return f"rsi_{self.period}_{self.low:g}_{self.high:g}"

    def position(self) -> Column:
        rsi, ready = F.col(f"rsi_{self.period}"), rsi_ready(self.period)
        return F.when(ready & (rsi < self.low), F.lit(1)).when(ready & (rsi > self.high), F.lit(-1)).otherwise(F.lit(0))


Rule = Crossover | RsiBand
DEFAULT_RULES: tuple[Rule, ...] = (Crossover(5, 20), Crossover(20, 50), RsiBand(7, 25, 75), RsiBand(14))


def backtest(ticks: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, split: HotSplit = DEFAULT_SPLIT) -> DataFrame:
    """Per ticker and rule: trades, ticks held, hit rate, total log return, largest drawdown of it."""
    periods = {p for rule in rules if isinstance(rule, Crossover) for p in (rule.fast, rule.slow)}
    spec = IndicatorSpec(
        sma=tuple(sorted(periods)),
        rsi=tuple(sorted({rule.period for rule in rules if isinstance(rule, RsiBand)})),
        vwap=False,
    )
    needed = valid_ticks(ticks).select("ticker", "ts", "seq", "price", "volume")
    known = with_indicators(needed, spec, split, keep_pieces=True)
    earned = F.coalesce(F.ln(F.try_divide(F.col("next_price"), F.col("price"))), F.lit(0.0))
    held = known.select(
        "ticker",
        "piece",
        "tick_no",
        F.col("next_price").isNotNull().alias("_open"),
        earned.alias("_earned"),
        *[rule.position().alias(f"_pos_{i}") for i, rule in enumerate(rules)],
    )

    ordered = Window.partitionBy("ticker", "piece").orderBy("tick_no")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curves: dict[str, Column] = {}
    for i in range(len(rules)):
        position = F.col(f"_pos_{i}")
        curves[f"_before_{i}"] = F.lag(position).over(ordered)
        curves[f"_sum_{i}"] = F.sum(position * F.col("_earned")).over(running)
    held = held.withColumns(curves)
    held = held.withColumns({f"_top_{i}": F.max(f"_sum_{i}").over(running) for i in range(len(rules))})

    pieces = held.groupBy("ticker", "piece").agg(*[_piece_result(i).alias(f"_rule_{i}") for i in range(len(rules))])
    results = F.explode(
        F.array(*[F.struct(F.lit(rule.name).alias("rule"), F.col(f"_rule_{i}").alias("r")) for i, rule in enumerate(rules)])
    )
    return _joined_pieces(pieces.select("ticker", "piece", results.alias("_")).select("ticker", "piece", "_.rule", "_.r.*"))


def _piece_result(i: int) -> Column:
    position, before, level, top = (F.col(f"_{name}_{i}") for name in ("pos", "before", "sum", "top"))
    made = position * F.col("_earned")
    active = (position != 0) & F.col("_open")
    zero = F.lit(0.0)
    return F.struct(
        F.sum(made).alias("total"),
        F.greatest(F.max(level), zero).alias("top"),
        F.least(F.min(level), zero).alias("bottom"),
        F.max(F.greatest(top, zero) - level).alias("drawdown"),
        F.count(F.when((position != 0) & (position != before), 1)).alias("entries"),
        F.min_by(position, "tick_no").alias("first_pos"),
        F.max_by(position, "tick_no").alias("last_pos"),
        F.count(F.when(active, 1)).alias("held"),
        F.count(F.when(active & (made > 0), 1)).alias("won"),
    )


def _joined_pieces(pieces: DataFrame) -> DataFrame:
    """A ticker's pieces put together in order; one row each, so these windows stay small."""
    ordered = Window.partitionBy("ticker", "rule").orderBy("piece")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    pieces = pieces.withColumns(
        {
            "start": F.coalesce(F.sum("total").over(earlier), zero),
            "came_from": F.coalesce(F.lag("last_pos").over(ordered), F.lit(0)),
        }
    )
    pieces = pieces.withColumn(
        "high", F.greatest(F.coalesce(F.max(F.col("start") + F.col("top")).over(earlier), zero), zero)
    )
    new_entry = (F.col("first_pos") != 0) & (F.col("first_pos") != F.col("came_from"))
    across = F.col("high") - (F.col("start") + F.col("bottom"))
    return pieces.groupBy("ticker", "rule").agg(
        F.sum(F.col("entries") + new_entry.cast("long")).alias("trades"),
        F.sum("held").alias("held"),
        F.try_divide(F.sum("won").cast("double"), F.sum("held").cast("double")).alias("hit_rate"),
        F.sum("total").alias("log_return"),
        F.max(F.greatest("drawdown", across, zero)).alias("max_drawdown"),
    )
