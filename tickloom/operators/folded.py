"""The indicators at the end of each ticker, folded piece by piece.

A piece holds a ticker's ticks of one span of time. Its state has a fixed size: how many ticks, the last prices,
sums for VWAP, and for each RSI what the piece does to the two averages, an affine map. States of pieces are merged
in the order of time, so no row per tick is kept, nothing has to be counted beforehand, and a ticker however hot is
spread over as many tasks as it has spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.columns import duration
from ..functions.stepper import IndicatorSpec, advance
from ..schema import TICK_ORDER
from .indicators import _by_piece, _entered, _local, _piece_states

_NO_PIECE = -(1 << 62)


def final_indicators(ticks: DataFrame, valid: Column, spec: IndicatorSpec, span: str = "1d") -> DataFrame:
    """``ticker, ticks, seen, last_price``, the indicators of ``spec`` and ``vwap`` after the last valid tick.

    ``ticks`` counts all rows of a ticker and ``seen`` the ``valid`` ones; without any of these all values are 0.
    """
    if spec.rsi_seed != "zero" or spec.reset_by:
        raise ValueError("only smoothing that starts from zero and is never reset can be folded")
    micros = int(duration(span).total_seconds() * 1_000_000)
    # Ticks without a time come first, as they do in the order of ticks.
    spans = F.coalesce(F.floor(F.unix_micros("ts") / micros).cast("long"), F.lit(_NO_PIECE + 1))
    piece = F.when(valid, spans).otherwise(F.lit(_NO_PIECE))
    rows = ticks.withColumn("_piece", piece)
    grouped, head = ["ticker", "_piece"], spec.longest + 1
    local = _local(rows, grouped, list(TICK_ORDER), spec)
    size = F.count(F.lit(1)).over(Window.partitionBy(*grouped))
    states = _piece_states(local.withColumn("_left", size - 1 - F.col("_at")), grouped, spec, head)

    # Rows that are not valid make a piece of their own, which changes nothing but the number of ticks.
    real = F.col("_piece") != _NO_PIECE
    nothing = F.array().cast("array<double>")
    cleared = {"rows": F.col("size"), "size": F.when(real, F.col("size")).otherwise(F.lit(0).cast("long"))}
    cleared |= {name: F.when(real, F.col(name)).otherwise(nothing) for name in ("first_prices", "last_prices")}
    cleared |= {name: F.when(real, F.col(name)).otherwise(F.lit(0.0)) for name in ("money", "volume") if spec.vwap}
    states = states.withColumns(cleared)
    onward = Window.partitionBy("ticker").orderBy("_piece")
    earlier = onward.rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("last_prices", -1)
    states = states.withColumns(
        {
            "_before": F.coalesce(F.sum("size").over(earlier), F.lit(0)),
            "_tail": F.filter(F.array(F.lag(F.when(F.size("last_prices") > 0, last)).over(onward)), lambda price: price.isNotNull()),
        }
    )
    return _merged(_with_maps(states, grouped, spec, head), spec)


def _with_maps(states: DataFrame, grouped: list[str], spec: IndicatorSpec, head: int) -> DataFrame:
    """Append, for each RSI, what a piece does to the averages up to its end, and up to its last move if it has one."""

    def maps(row: dict) -> dict:
        prices = np.asarray(row["first_prices"], dtype=float)
        state = _entered(row, spec)
        previous = state.tail[-1:] or prices[:1].tolist()
        changed = np.diff(np.concatenate([previous, prices])) != 0
        number = state.seen + np.arange(len(prices))
        advance(state, prices, spec)
        out = {}
        for p, smoothed in state.smoothed.items():
            decay, rest = (p - 1) / p, row["size"] - head
            at_head = {name: getattr(smoothed, f"avg_{name}") for name in ("gain", "loss")}
            differ = {name: at_head[name] - row[f"head_{name}_{p}"] if rest > 0 else 0.0 for name in at_head}
            moved = np.flatnonzero((changed | (p == 1)) & (number >= p))
            if rest > 0 and row[f"moved_{p}"] >= head:
                fade = decay ** (row[f"moved_{p}"] - head + 1)
                out[f"_move_times_{p}"] = fade * decay**head
                out |= {f"_move_{name}_{p}": row[f"moved_{name}_{p}"] + fade * differ[name] for name in differ}
            elif len(moved):
                upto = _entered(row, spec)
                advance(upto, prices[: moved[-1] + 1], spec)
                out[f"_move_times_{p}"] = decay ** int(moved[-1] + 1)
                out |= {f"_move_{name}_{p}": getattr(upto.smoothed[p], f"avg_{name}") for name in differ}
            else:
                out |= dict.fromkeys([f"_move_times_{p}", f"_move_gain_{p}", f"_move_loss_{p}"])
            out[f"_times_{p}"] = decay ** row["size"]
            for name in differ:
                end = row[f"end_{name}_{p}"] + decay**rest * differ[name] if rest > 0 else at_head[name]
                out[f"_{name}_{p}"] = end
        return out

    names = [f"_{kind}_{p}" for p in spec.rsi for kind in ("times", "gain", "loss", "move_times", "move_gain", "move_loss")]
    tasks = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _by_piece(states, grouped, tasks, maps, [T.StructField(name, T.DoubleType()) for name in names])


def _merged(states: DataFrame, spec: IndicatorSpec) -> DataFrame:
    """The pieces of each ticker merged in order; a ticker's pieces are one small row each."""
    kept = ["_piece", "rows", "size", "last_prices", *(("money", "volume") if spec.vwap else ())]
    kept += [f"_{kind}_{p}" for p in spec.rsi for kind in ("times", "gain", "loss", "move_times", "move_gain", "move_loss")]
    pieces = states.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("pieces"))
    numbers = F.array().cast("array<double>")
    start = [F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("seen"), numbers.alias("tail")]
    start += [F.lit(0.0).alias(name) for name in ("money", "volume")]
    for p in spec.rsi:
        start += [F.lit(0.0).alias(f"gain_{p}"), F.lit(0.0).alias(f"loss_{p}"), F.lit(100.0).alias(f"index_{p}")]

    def merge(state: Column, piece: Column) -> Column:
        tail = F.concat(state["tail"], piece["last_prices"])
        tail = F.slice(tail, F.greatest(F.size(tail) - spec.longest + 1, F.lit(1)), spec.longest)
        fields = [(state["rows"] + piece["rows"]).alias("rows"), (state["seen"] + piece["size"]).alias("seen"), tail.alias("tail")]
        for name in ("money", "volume"):
            fields.append((state[name] + piece[name] if spec.vwap else state[name]).alias(name))
        for p in spec.rsi:
            gain, loss = state[f"gain_{p}"], state[f"loss_{p}"]

            def passed(kind: str, name: str, value: Column) -> Column:
                return F.greatest(piece[f"_{kind}{name}_{p}"] + piece[f"_{kind}times_{p}"] * value, F.lit(0.0))  # noqa: B023

            fields += [passed("", "gain", gain).alias(f"gain_{p}"), passed("", "loss", loss).alias(f"loss_{p}")]
            index = C.rsi_of(passed("move_", "gain", gain), passed("move_", "loss", loss))
            fields.append(F.when(piece[f"_move_times_{p}"].isNull(), state[f"index_{p}"]).otherwise(index).alias(f"index_{p}"))
        return F.struct(*fields)

    end = pieces.select("ticker", F.aggregate("pieces", F.struct(*start), merge).alias("end")).select("ticker", "end.*")

    def mean(period: int) -> Column:
        recent = F.slice("tail", F.greatest(F.size("tail") - period + 1, F.lit(1)), period)
        total = F.aggregate(recent, F.lit(0.0), lambda a, b: a + b)
        return F.when(F.col("seen") >= period, total / period).otherwise(F.lit(0.0))

    values = [mean(p).alias(f"sma_{p}") for p in spec.sma]
    values += [F.when(F.col("seen") > p, F.col(f"index_{p}")).otherwise(F.lit(0.0)).alias(f"rsi_{p}") for p in spec.rsi]
    if spec.vwap:
        values.append(F.when(F.col("volume") > 0, F.col("money") / F.col("volume")).otherwise(F.lit(0.0)).alias("vwap"))
    price = F.coalesce(F.try_element_at("tail", F.lit(-1)), F.lit(0.0)).alias("last_price")
    return end.select("ticker", F.col("rows").alias("ticks"), "seen", price, *values)
