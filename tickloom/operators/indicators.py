"""Moving average, relative strength index and VWAP over each ticker's ticks in order.

All of a ticker's indicators share one shuffle and two sorts. The RSI recurrence
``A[n] = q * A[n-1] + g[n] / p`` has no window function; it is summed in blocks short enough that
the weights ``q ** -i`` stay in range, and the blocks before are added with their decay, four, then
four times four of them in each round, until a weight is no longer a positive number.

Hot tickers (see :mod:`pieces`) are computed piece by piece as if each piece began a ticker, the
results are written once, and a small table with one row per piece says how to correct them. What a
piece does to an average is an affine map, so the averages at the entry of all pieces are a prefix of
composed maps, found by doubling, and the first rows of each piece are worked out piece by piece in
parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.stepper import DEFAULT_SPEC, IndicatorSpec, Smoothed, TickerState, advance
from ..schema import TICK_ORDER
from ..session import scratch_path
from .pieces import DEFAULT_SPLIT, HotSplit, divide, find_hot

_PERIODS_PER_BLOCK = 18
# Weights inside a block stay below e**600.
_LARGEST_EXPONENT = 600.0
# Moving averages up to this period are summed row by row when nothing else needs blocks.
_SHORT_FRAME = 16
_SMA_BLOCK = 256
_BROADCAST_BYTES = 256 * 1024 * 1024


def with_indicators(
    ticks: DataFrame,
    spec: IndicatorSpec = DEFAULT_SPEC,
    split: HotSplit = DEFAULT_SPLIT,
    keep_pieces: bool = False,
) -> DataFrame:
    """Append ``tick_no``, ``sma_<p>``, ``rsi_<p>``, ``vwap`` and ``vwap_ready`` to each valid tick.

    ``ticks`` must hold valid ticks only (see :func:`validate.valid_ticks`). Values are 0.0 until
    an indicator is ready. ``keep_pieces`` also appends ``piece`` and the following ``next_price``.
    The input is counted before it is used, so store it first if it is costly to compute.
    """
    if ticks.isStreaming:
        raise ValueError("use streaming.enrich for a stream")
    by = ["ticker", *spec.reset_by]
    order = list(TICK_ORDER)
    hot = find_hot(ticks, by, split)
    if hot is None:
        return _whole(ticks, by, order, spec, keep_pieces)
    cold, pieces = divide(ticks, by, order, hot)
    corrected = _corrected(pieces, by, order, spec, keep_pieces, hot.pieces)
    return _whole(cold, by, order, spec, keep_pieces).unionByName(corrected)


def sma_ready(period: int) -> Column:
    return F.col("tick_no") >= period


def rsi_ready(period: int) -> Column:
    return F.col("tick_no") > period


def _whole(ticks: DataFrame, by: list[str], order: list[str], spec: IndicatorSpec, keep_pieces: bool) -> DataFrame:
    local = _local(ticks, by, order, spec)
    columns = [F.col(name) for name in ticks.columns]
    columns.append((F.col("_at") + 1).alias("tick_no"))
    columns += [F.col(f"_sma_{p}").alias(f"sma_{p}") for p in spec.sma]
    for p in spec.rsi:
        last = F.col(f"_last_{p}")
        value = F.when(last.isNull(), F.lit(100.0)).otherwise(C.rsi_of(last["avg_gain"], last["avg_loss"]))
        columns.append(F.when(F.col("_at") < p, F.lit(0.0)).otherwise(value).alias(f"rsi_{p}"))
    if spec.vwap:
        columns += _vwap(F.col("_money"), F.col("_volume"))
    if keep_pieces:
        columns += [F.lit(0).alias("piece"), F.col("_next").alias("next_price")]
    return local.select(*columns)


def _vwap(money: Column, volume: Column) -> list[Column]:
    ready = volume > 0
    return [
        F.when(ready, F.try_divide(money, volume)).otherwise(F.lit(0.0)).alias("vwap"),
        ready.alias("vwap_ready"),
    ]


@dataclass(frozen=True)
class _Blocks:
    """Periods summed in blocks of one size, so that they share a sort."""

    size: int
    rsi: tuple[int, ...]
    sma: tuple[int, ...]


def _plan_blocks(spec: IndicatorSpec) -> list[_Blocks]:
    """As few block sizes as the weights allow; the largest also serves the moving averages."""
    groups: list[_Blocks] = []
    waiting = sorted({p for p in spec.rsi if p > 1}, reverse=True)
    sma = tuple(spec.sma)
    while waiting:
        size = _PERIODS_PER_BLOCK * waiting[0]
        if sma and size < max(sma) and max(sma) * _growth(waiting[0]) < _LARGEST_EXPONENT:
            size = max(sma)
        together = tuple(p for p in waiting if size * _growth(p) < _LARGEST_EXPONENT)
        waiting = [p for p in waiting if p not in together]
        served = sma if sma and size >= max(sma) else ()
        sma = () if served else sma
        groups.append(_Blocks(size, together, served))
    if sma and max(sma) > _SHORT_FRAME:
        groups.append(_Blocks(max(_SMA_BLOCK, *sma), (), sma))
    return groups


def _growth(period: int) -> float:
    return math.log(period / (period - 1))


def _local(ticks: DataFrame, by: list[str], order: list[str], spec: IndicatorSpec) -> DataFrame:
    """Window columns of every group ``by``, each group taken as a whole ticker.

    ``_at`` counts from 0; ``_gain_p`` / ``_loss_p`` are the averages at the row, ``_last_p`` the
    averages at the latest row that moved.
    """
    ordered = Window.partitionBy(*by).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    price = F.col("price")

    place = F.row_number().over(ordered).cast("long")
    columns: dict[str, Column] = {"_at": place - 1, "_next": F.lead(price).over(ordered)}
    if spec.rsi:
        columns["_change"] = F.coalesce(price - F.lag(price).over(ordered), F.lit(0.0))
    if spec.vwap:
        high, low, volume = F.col("high"), F.col("low"), F.col("volume")
        counted = C.counts_for_vwap(price, high, low, volume)
        money = F.when(counted, C.typical_price(price, high, low) * volume).otherwise(0.0)
        columns["_money"] = F.sum(money).over(running)
        columns["_volume"] = F.sum(F.when(counted, volume.cast("double")).otherwise(0.0)).over(running)
    groups = _plan_blocks(spec)
    for p in set(spec.sma) - {p for group in groups for p in group.sma}:
        mean = F.avg(price).over(ordered.rowsBetween(-(p - 1), Window.currentRow))
        columns[f"_sma_{p}"] = F.when(place >= p, mean).otherwise(0.0)
    local = ticks.select("*", *[column.alias(name) for name, column in columns.items()])
    local = _amounts(local, by, order, spec)
    for group in groups:
        local = _block_sums(local, by, group)
    for p in set(spec.rsi) & {1}:
        local = local.withColumn("_last_1", F.when(F.col("_at") >= 1, _state(1)))
    return local


def _amounts(df: DataFrame, by: list[str], order: list[str], spec: IndicatorSpec) -> DataFrame:
    """Append what each row adds to the averages of each RSI period, as ``_gain_p`` / ``_loss_p``."""
    at, change = F.col("_at"), F.col("_change")
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {}
    for p in spec.rsi:
        for name, amount in (("gain", C.gain(change)), ("loss", C.loss(change))):
            if spec.rsi_seed == "wilder":
                first = F.sum(F.when(at <= p, amount).otherwise(0.0)).over(running)
                amount = F.when(at == p, first).otherwise(amount)
            columns[f"_{name}_{p}"] = F.when(at >= p, amount / p).otherwise(0.0)
    return df.withColumns(columns) if columns else df


def _state(period: int) -> Column:
    return F.struct(
        F.col(f"_gain_{period}").alias("avg_gain"), F.col(f"_loss_{period}").alias("avg_loss"), F.col("_at").alias("at")
    )


def _block_sums(df: DataFrame, by: list[str], group: _Blocks) -> DataFrame:
    """Turn ``_gain_p`` / ``_loss_p`` into averages, and append ``_last_p`` and ``_sma_p``.

    Sums start over with each block and the blocks before are added, so every row costs the same
    whatever the periods, and no sum grows with the length of the ticker.
    """
    df = df.withColumns(
        {"_block": F.floor(F.col("_at") / group.size).cast("long"), "_in_block": (F.col("_at") % group.size).cast("int")}
        | {f"_moved_{p}": (F.col(f"_gain_{p}") > 0) | (F.col(f"_loss_{p}") > 0) for p in group.rsi}
    )
    in_block = F.col("_in_block")
    inside = Window.partitionBy(*by, "_block").orderBy("_in_block")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = Window.partitionBy(*by).orderBy("_block")
    onward = Window.partitionBy(*by).orderBy("_block", "_in_block")
    sofar = onward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = [(name, p) for p in group.rsi for name in ("gain", "loss")]

    # What a row adds, lifted to the start of its block. The sums never fall, so a block's total is
    # its largest.
    sums = {
        f"_inside_{name}_{p}": F.sum(F.col(f"_{name}_{p}") * F.pow(F.lit(p / (p - 1)), in_block)).over(inside)
        for name, p in pairs
    }
    if group.sma:
        sums["_inside_price"] = F.sum("price").over(inside)
    df = df.withColumns(sums)
    df, entries = _block_entries(df, blocks, group, pairs)
    averages = {
        f"_{name}_{p}": (F.col(f"_inside_{name}_{p}") + F.col(entries[name, p])) * F.pow(F.lit((p - 1) / p), in_block)
        for name, p in pairs
    }
    if group.sma:
        averages["_before_price"] = F.max("_inside_price").over(blocks.rangeBetween(-1, -1))
    df = df.withColumns(averages)
    # An unchanged price scales both averages alike and leaves the index as it was.
    ends = {
        f"_last_{p}": F.last(F.when(F.col(f"_moved_{p}"), _state(p)), ignorenulls=True).over(sofar) for p in group.rsi
    }
    for p in group.sma:
        # The sum since the block began, less what lies more than p rows back; if that is in the block
        # before, with the rest of that block.
        crossing = F.when(in_block < p, F.coalesce("_before_price", F.lit(0.0))).otherwise(0.0)
        dropped = F.coalesce(F.lag("_inside_price", p).over(onward), F.lit(0.0))
        mean = (F.col("_inside_price") + (crossing - dropped)) / p
        ends[f"_sma_{p}"] = F.when(F.col("_at") >= p - 1, mean).otherwise(0.0)
    spent = {f"_inside_{name}_{p}" for name, p in pairs} | {f"_moved_{p}" for p in group.rsi} | set(entries.values())
    spent |= {"_block", "_in_block", "_inside_price", "_before_price"}
    kept = [name for name in df.columns if name not in spent]
    return df.select(*kept, *[column.alias(name) for name, column in ends.items()])


def _block_entries(
    df: DataFrame, blocks: WindowSpec, group: _Blocks, pairs: list[tuple[str, int]]
) -> tuple[DataFrame, dict[tuple[str, int], str]]:
    """Append, for every row of a block, what the blocks before leave, as it stands at the block's first row.

    The first round sums the last four blocks, each further one four of the sums before it.
    """
    entries: dict[tuple[str, int], str] = {}
    span = 1
    while True:
        columns = {}
        for name, p in pairs:
            weights = {back: ((p - 1) / p) ** (group.size * back) for back in range(0, 4 * span + 1, span)}
            if span == 1:
                terms = [(f"_inside_{name}_{p}", back) for back in range(1, 5)]
            else:
                terms = [(entries[name, p], back) for back in range(span, 4 * span, span)]
            reached = [(source, back) for source, back in terms if weights[back] > 0]
            if reached:
                # All rows of a block hold the same sum, or sums that never fall.
                total = F.lit(0.0) if span == 1 else F.col(entries[name, p])
                for source, back in reached:
                    before = F.max(source).over(blocks.rangeBetween(-back, -back))
                    total = total + F.coalesce(before, F.lit(0.0)) * F.lit(weights[back])
                columns[name, p] = total
        if not columns and span > 1:
            return df, entries
        fresh = {key: f"_entry_{key[0]}_{key[1]}" + (f"_{span}" if span > 1 else "") for key in columns}
        df = df.withColumns({fresh[key]: column for key, column in columns.items()})
        dropped = [entries[key] for key in fresh if key in entries]
        entries |= fresh
        if span == 1:
            for key in set(pairs) - set(entries):
                entries[key] = f"_entry_{key[0]}_{key[1]}"
                df = df.withColumn(entries[key], F.lit(0.0))
        df = df.drop(*dropped)
        span *= 4


def _corrected(
    pieces: DataFrame, by: list[str], order: list[str], spec: IndicatorSpec, keep_pieces: bool, count: int
) -> DataFrame:
    spark = pieces.sparkSession
    grouped = [*by, "_piece"]
    whole = Window.partitionBy(*grouped)
    head = spec.longest + 1
    local = _local(pieces, grouped, order, spec).withColumn("_left", F.count(F.lit(1)).over(whole) - 1 - F.col("_at"))
    # The averages are read back at two rows of a piece only, the distance to its end near the end.
    ends = (F.col("_at") == head - 1) | (F.col("_left") == 0)
    averages = [f"_{name}_{p}" for p in spec.rsi for name in ("gain", "loss")]
    local = local.withColumns({name: F.when(ends, F.col(name)) for name in averages}).withColumn(
        "_left", F.when(F.col("_left") < head, F.col("_left"))
    )
    local = local.drop("_change", *(() if keep_pieces else ("_next",)))
    path = scratch_path(spark, "pieces")
    local.write.parquet(path)
    local = spark.read.schema(local.schema).parquet(path)

    entry = _entries(local, grouped, by, spec, head, count)
    # One row per piece and key (a piece may hold the end of one key and the start of the next), and
    # HotSplit.max_pieces bounds both; long periods make the rows wide.
    values = (len(spec.sma) + len(spec.rsi)) * head + 3 * len(spec.rsi) + 4
    if 2 * count * values * 8 <= _BROADCAST_BYTES:
        entry = F.broadcast(entry)
    joined = local.join(entry, grouped)

    at = F.col("_at")
    in_head = at < head
    since_head = F.lit(head - 1)
    columns = [F.col(name) for name in pieces.columns if name != "_piece"]
    columns.append((F.col("_before") + at + 1).alias("tick_no"))
    for p in spec.sma:
        columns.append(
            F.when(in_head, F.get(f"_head_sma_{p}", at.cast("int"))).otherwise(F.col(f"_sma_{p}")).alias(f"sma_{p}")
        )
    for p in spec.rsi:
        last, decay = F.col(f"_last_{p}"), (p - 1) / p
        fade = F.pow(F.lit(decay), last["at"] - since_head)
        value = F.when(last.isNull() | (last["at"] < head), F.col(f"_value_{p}")).otherwise(
            C.rsi_of(
                F.greatest(last["avg_gain"] + fade * F.col(f"_add_gain_{p}"), F.lit(0.0)),
                F.greatest(last["avg_loss"] + fade * F.col(f"_add_loss_{p}"), F.lit(0.0)),
            )
        )
        columns.append(F.when(in_head, F.get(f"_head_rsi_{p}", at.cast("int"))).otherwise(value).alias(f"rsi_{p}"))
    if spec.vwap:
        columns += _vwap(F.col("_money") + F.col("_money_before"), F.col("_volume") + F.col("_volume_before"))
    if keep_pieces:
        following = F.when(F.col("_left") == 0, F.col("_price_after")).otherwise(F.col("_next"))
        columns += [F.col("_piece").alias("piece"), following.alias("next_price")]
    return joined.select(*columns)


def _entries(
    local: DataFrame, grouped: list[str], by: list[str], spec: IndicatorSpec, head: int, count: int
) -> DataFrame:
    """One row per piece: what the pieces before it leave behind.

    Moving averages and RSI of the first ``head`` rows are worked out anew from the state at entry.
    Past them a moving average needs nothing, and the RSI averages differ from the local ones by a
    difference that only decays.
    """
    return _carried(_piece_states(local, grouped, spec, head), grouped, by, spec, head, count)


def _piece_states(local: DataFrame, grouped: list[str], spec: IndicatorSpec, head: int) -> DataFrame:
    """One row per piece: its first and last prices, sums, and averages as if it began a ticker."""
    at, left = F.col("_at"), F.col("_left")
    last_row, head_row = left == 0, at == head - 1

    def pick(row: Column, name: str) -> Column:
        return F.max(F.when(row, F.col(name)))

    def prices(rows: Column) -> Column:
        placed = F.sort_array(F.collect_list(F.when(rows, F.struct("_at", "price"))))
        return F.transform(placed, lambda item: item["price"])

    columns = [
        F.count(F.lit(1)).alias("size"),
        prices(at < head).alias("first_prices"),
        prices(left < spec.longest).alias("last_prices"),
    ]
    if spec.vwap:
        columns += [pick(last_row, "_money").alias("money"), pick(last_row, "_volume").alias("volume")]
    for p in spec.rsi:
        for name in ("gain", "loss"):
            columns.append(pick(head_row, f"_{name}_{p}").alias(f"head_{name}_{p}"))
            columns.append(pick(last_row, f"_{name}_{p}").alias(f"end_{name}_{p}"))
        columns.append(pick(last_row, f"_last_{p}").alias(f"_last_{p}"))
    summary = local.groupBy(*grouped).agg(*columns)
    for p in spec.rsi:
        last = F.col(f"_last_{p}")
        summary = summary.withColumns(
            {f"moved_{p}": last["at"], f"moved_gain_{p}": last["avg_gain"], f"moved_loss_{p}": last["avg_loss"]}
        ).drop(f"_last_{p}")

    return summary


def _carried(
    summary: DataFrame, grouped: list[str], by: list[str], spec: IndicatorSpec, head: int, count: int
) -> DataFrame:
    """``summary``, one row per piece, with what the pieces before leave behind."""
    onward = Window.partitionBy(*by).orderBy("_piece")
    earlier = onward.rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str, default: float | int = 0) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(default))

    state = {"_before": before("size"), "_price_after": F.lead(F.col("first_prices")[0]).over(onward)}
    for name in ("money", "volume"):
        state[f"_{name}_before"] = before(name, 0.0) if spec.vwap else F.lit(0.0)
    known = summary.withColumns(state)
    # A piece has a row at least, so that many pieces back hold all the prices that the first rows look at.
    recent = F.flatten(F.collect_list("last_prices").over(onward.rowsBetween(-spec.longest, -1)))
    known = known.withColumn("_tail", F.coalesce(recent, F.array().cast("array<double>")))
    known = known.withColumn("_tail", F.slice("_tail", F.greatest(F.size("_tail") - spec.longest + 1, F.lit(1)), spec.longest))
    if not spec.rsi:
        return _apply_heads(known, grouped, spec, head, count).drop(*summary.drop(*grouped).columns, "_tail")

    known = _apply_maps(known, grouped, spec, head, count)
    keys = [(name, p) for p in spec.rsi for name in ("gain", "loss")]
    known = known.withColumns({f"_seed_before_{n}_{p}": before(f"_seed_{n}_{p}", 0.0) for n, p in keys})
    known = known.withColumns(
        {f"_add_{n}_{p}": F.col(f"_map_{n}_{p}") + F.col(f"_coef_{p}") * F.col(f"_seed_before_{n}_{p}") for n, p in keys}
        | {f"_times_{p}": F.pow(F.lit((p - 1) / p), F.col("size")) for p in spec.rsi}
    )
    # After round k a row holds the composed map of its piece and the 2**k - 1 before it.
    for step in range(math.ceil(math.log2(count)) if count > 1 else 0):
        lag = lambda name: F.coalesce(F.lag(name, 1 << step).over(onward), F.lit(0.0))  # noqa: B023, E731
        known = known.withColumns(
            {f"_add_{n}_{p}": F.col(f"_add_{n}_{p}") + F.col(f"_times_{p}") * lag(f"_add_{n}_{p}") for n, p in keys}
            | {f"_times_{p}": F.col(f"_times_{p}") * lag(f"_times_{p}") for p in spec.rsi}
        )
    known = known.withColumns({f"_entry_{n}_{p}": F.coalesce(F.lag(f"_add_{n}_{p}").over(onward), F.lit(0.0)) for n, p in keys})
    known = known.drop(*[f"_{kind}_{n}_{p}" for n, p in keys for kind in ("map", "add", "seed")])
    known = known.drop(*[f"_{kind}_{p}" for p in spec.rsi for kind in ("times", "coef")])
    known = _apply_heads(known, grouped, spec, head, count)
    # Until the price of a piece moves, the index is what the last move before left.
    filled = {}
    for p in spec.rsi:
        left = F.coalesce(F.last(f"_exit_{p}", ignorenulls=True).over(earlier), F.lit(100.0))
        filled[f"_head_rsi_{p}"] = F.transform(f"_head_rsi_{p}", lambda value: F.coalesce(value, F.col(f"_left_{p}")))  # noqa: B023
        filled[f"_value_{p}"] = F.coalesce(f"_value_{p}", F.col(f"_left_{p}"))
        known = known.withColumn(f"_left_{p}", left)
    known = known.withColumns(filled)
    spent = [f"_{kind}_{p}" for p in spec.rsi for kind in ("left", "exit")]
    spent += [f"_{kind}_{n}_{p}" for n, p in keys for kind in ("entry", "seed_before")]
    return known.drop(*spent, *summary.drop(*grouped).columns, "_tail")


def _by_piece(known: DataFrame, grouped: list[str], count: int, apply: Callable[[dict], dict], added: list[T.StructField]) -> DataFrame:
    """``apply`` to every row, spread over tasks by piece."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                new = pd.DataFrame([apply(row) for row in frame.to_dict("records")], index=frame.index)
                yield pd.concat([frame, new], axis=1)

    tasks = min(count, int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return known.repartition(tasks, *grouped).mapInPandas(run, T.StructType([*known.schema.fields, *added]))


def _entered(row: dict, spec: IndicatorSpec) -> TickerState:
    state = TickerState.start(spec)
    state.seen, state.tail = int(row["_before"]), [float(price) for price in row["_tail"]]
    return state


def _apply_maps(known: DataFrame, grouped: list[str], spec: IndicatorSpec, head: int, count: int) -> DataFrame:
    """Append the map of each piece: the average at its end is ``q ** size`` times the one at its entry,
    plus ``_map`` and, where the smoothing starts in it, ``_coef`` times the seed gathered before."""

    def maps(row: dict) -> dict:
        state = _entered(row, spec)
        advance(state, np.asarray(row["first_prices"], dtype=float), spec)
        first, rest = len(row["first_prices"]), row["size"] - head
        out = {}
        for p, smoothed in state.smoothed.items():
            decay = (p - 1) / p
            starts = spec.rsi_seed == "wilder" and 0 <= p - row["_before"] < first
            out[f"_coef_{p}"] = decay ** (row["size"] - 1 - (p - row["_before"])) / p if starts else 0.0
            for name in ("gain", "loss"):
                value = getattr(smoothed, f"avg_{name}")
                if rest > 0:
                    value = row[f"end_{name}_{p}"] + decay**rest * (value - row[f"head_{name}_{p}"])
                out[f"_map_{name}_{p}"], out[f"_seed_{name}_{p}"] = value, getattr(smoothed, f"seed_{name}")
        return out

    added = [T.StructField(f"_coef_{p}", T.DoubleType()) for p in spec.rsi]
    added += [T.StructField(f"_{kind}_{n}_{p}", T.DoubleType()) for p in spec.rsi for n in ("gain", "loss") for kind in ("map", "seed")]
    return _by_piece(known, grouped, count, maps, added)


def _apply_heads(known: DataFrame, grouped: list[str], spec: IndicatorSpec, head: int, count: int) -> DataFrame:
    """Append the indicators of the first ``head`` rows of each piece and how the rows after them differ.

    An index is NULL while no price of the piece has moved.
    """

    def heads(row: dict) -> dict:
        state = _entered(row, spec)
        for p, smoothed in state.smoothed.items():
            smoothed.value = math.nan
            for name in ("gain", "loss"):
                setattr(smoothed, f"avg_{name}", max(row[f"_entry_{name}_{p}"], 0.0))
                setattr(smoothed, f"seed_{name}", row[f"_seed_before_{name}_{p}"])
        first = advance(state, np.asarray(row["first_prices"], dtype=float), spec)
        out = {f"_head_{name}": [None if math.isnan(v) else v for v in values.tolist()] for name, values in first.items()}
        for p, smoothed in state.smoothed.items():
            out |= {f"_value_{p}": smoothed.value, f"_add_gain_{p}": 0.0, f"_add_loss_{p}": 0.0}
            if row["size"] > head:
                _skip_rest(out, row, p, smoothed, head)
            out[f"_exit_{p}"] = smoothed.value
            for name in ("value", "exit"):
                value = out[f"_{name}_{p}"]
                out[f"_{name}_{p}"] = None if math.isnan(value) else value
        return out

    added = [T.StructField(f"_head_sma_{p}", T.ArrayType(T.DoubleType())) for p in spec.sma]
    for p in spec.rsi:
        added.append(T.StructField(f"_head_rsi_{p}", T.ArrayType(T.DoubleType())))
        added += [T.StructField(f"_{name}_{p}", T.DoubleType()) for name in ("value", "add_gain", "add_loss", "exit")]
    return _by_piece(known, grouped, count, heads, added)


def _skip_rest(out: dict, row: dict, p: int, smoothed: Smoothed, head: int) -> None:
    """How the averages past the head differ from the local ones, and the index at the last row that moved."""
    decay = (p - 1) / p
    add_gain = smoothed.avg_gain - row[f"head_gain_{p}"]
    add_loss = smoothed.avg_loss - row[f"head_loss_{p}"]
    out[f"_add_gain_{p}"], out[f"_add_loss_{p}"] = add_gain, add_loss
    if row[f"moved_{p}"] >= head:
        fade = decay ** (row[f"moved_{p}"] - head + 1)
        gain = max(row[f"moved_gain_{p}"] + fade * add_gain, 0.0)
        loss = max(row[f"moved_loss_{p}"] + fade * add_loss, 0.0)
        smoothed.value = 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss)
