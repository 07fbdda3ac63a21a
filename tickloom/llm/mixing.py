"""Mixing sources to target weights, in blocks of a fixed number of words.

The documents of a source stand in a row; every ``block_words`` words of it are a block, the last one may be
shorter. A target in words is thereby a number of block slots. Slots are dealt to output shards of
``shard_slots``: each slot draws its source with the target shares as probabilities, so the counts of a shard
are one multinomial draw. Over all shards a source may come out a few slots above or below its number; what
is above is handed to the sources that are short, so that the totals are exact. The j-th slot of a source
takes block ``perm(j mod blocks)`` of it, where ``perm`` is a pseudorandom permutation of the source's block
numbers for each pass (swap-or-not, Hoang, Morris and Rogaway 2012; a bijection on any domain, computed for a
slot alone). A source is thus read evenly: no block is used three times where the target stops at twice the
size.

All of this is DataFrame code. Draws, permutations and orders are functions of ids, contents and ``seed``, so
reruns agree. No window holds more than a shard's slots, ``bucket_docs`` documents or one row for each bucket
or shard of a source; the one gathered result is a row of totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, small, whole_text

WEIGHTS = (5, 2, 1)
CELLS = 65_536
ROUNDS = 12


@dataclass(frozen=True)
class Mix:
    """What a mix consists of.

    * ``sources``: ``source, source_no, source_size, weight, target, blocks, slots``;
    * ``slots``: ``shard, slot, source_no, block``, a row for each block of the output;
    * ``pieces``: ``source_no, block, doc_id, tie, row, words_from, n_words``, what each block holds;
    * ``taken``: ``doc_id, tie, source, size, source_size, target, taken``, a row for each document.
    """

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    taken: DataFrame


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, block_words: int) -> DataFrame:
    """The sources with weight, target and number of blocks and slots."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    numbered = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    numbered = numbered.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Rising ratio of cap to weight: a source is capped as long as the level that the rest would get reaches it.
    order = Window.orderBy((F.col("cap") / F.col("weight")), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levelled = capped.withColumn("level", level)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    rest = F.min_by(F.when(~full, F.col("level")), F.when(~full, F.struct(F.col("cap") / F.col("weight"), "source_no")))
    target = F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("weight") * rest.over(everything)))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    slots = F.round(F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0)))
    return (
        levelled.withColumn("target", target.cast("double"))
        .withColumn("blocks", blocks)
        .withColumn("slots", slots.cast("long"))
        .select("source", "source_no", "source_size", "docs", "weight", "target", "blocks", "slots")
    )


def _permuted(position: Column, n: Column, *key: Column) -> Column:
    """The place of ``position`` under a pseudorandom permutation of ``0 .. n - 1`` chosen by ``key``."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) + n - x, n)
        coin = F.xxhash64(*key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(coin, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), position, step)


def _slots(sources: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """``shard, slot, source_no, block``: multinomial draws for each shard, totals set right, blocks permuted."""
    spark = sources.sparkSession
    running = Window.orderBy("source_no")
    upto = F.sum("slots").over(running)
    edge = lambda c: F.floor(c * F.lit(CELLS) / F.lit(max(n_slots, 1))).cast("long")
    cells = sources.where("slots > 0").select("source_no", edge(upto - F.col("slots")).alias("lo"), edge(upto).alias("hi"))
    cells = cells.where("hi > lo").select("source_no", F.explode(F.expr("sequence(lo, hi - 1)")).alias("cell"))
    drawn = spark.range(n_slots).select(
        F.col("id").alias("slot"),
        F.floor(F.col("id") / shard_slots).cast("long").alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(CELLS)).alias("cell"),
    )
    drawn = drawn.join(F.broadcast(cells), "cell").drop("cell")  # CELLS rows
    drawn = saved(drawn, "mix-draws")
    counts = drawn.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    in_shard = Window.partitionBy("shard", "source_no").orderBy("slot")
    ranked = drawn.withColumn("nth", F.row_number().over(in_shard) - 1).join(first, ["source_no", "shard"])
    ranked = ranked.select("shard", "slot", "source_no", (F.col("first") + F.col("nth")).alias("rank"))

    totals = counts.groupBy("source_no").agg(F.sum("here").alias("drawn"))
    gap = sources.join(totals, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    gap = gap.select(
        "source_no", "blocks", "slots", "drawn",
        (F.sum(F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))).over(running) - F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))).alias("spare_before"),
        (F.sum(F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))).over(running) - F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))).alias("short_before"),
    )
    gap = saved(gap, "mix-gaps")
    wanted = gap.where("slots > drawn").select(
        F.col("source_no").alias("new_no"), "short_before", F.posexplode(F.expr("sequence(drawn, slots - 1)")).alias("at", "new_j")
    )
    wanted = wanted.select((F.col("short_before") + F.col("at")).alias("place"), "new_no", "new_j")
    # Of a source drawn too often every (drawn / spare)-th slot is spare, so no shard bears all of it.
    known = ranked.join(small(gap.select("source_no", "spare_before", "drawn", F.expr("greatest(drawn - slots, 0) AS spare"))), "source_no")
    known = known.withColumn("before", F.expr("rank * spare div drawn"))
    is_spare = F.expr("(rank + 1) * spare div drawn > before")
    right = known.where(~is_spare).select("shard", "slot", "source_no", F.expr("rank - before AS j"))
    spare = known.where(is_spare).withColumn("place", F.col("spare_before") + F.col("before"))
    moved = spare.join(wanted, "place").select("shard", "slot", F.col("new_no").alias("source_no"), F.col("new_j").alias("j"))
    settled = right.unionByName(moved).join(small(gap.select("source_no", "blocks")), "source_no")
    turn = F.floor(F.col("j") / F.col("blocks"))
    block = _permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source_no"), turn)
    return settled.select("shard", "slot", "source_no", block.alias("block"))


def _placed(sizes: DataFrame, sources: DataFrame, n_docs: int, block_words: int, bucket_docs: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in the row of their source, and their pieces by block."""
    buckets = max(1, -(-n_docs // bucket_docs))
    names = sources.select(F.col("source").alias("name"), "source_no", "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("name"))
    known = sizes.join(small(names), same).drop("name")
    known = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "tie", "size")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("row", F.row_number().over(inside))
    known = known.withColumn("local", F.coalesce(F.sum("size").over(before), F.lit(0)))
    sums = sizes.join(small(names.select("name", "source_no")), same)
    sums = sums.groupBy("source_no", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).alias("bucket"))
    sums = sums.agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    placed = known.join(bases, ["source_no", "bucket"]).withColumn("start", F.col("base") + F.col("local"))
    placed = saved(placed.drop("base", "local"), "mix-places")
    end = F.col("start") + F.col("size")
    blocks = F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")
    pieces = placed.where("size > 0").withColumn("block", F.explode(blocks))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(end, (F.col("block") + 1) * block_words)
    return placed, pieces.select(
        "source_no", "block", "bucket", "row", "doc_id", "tie", (low - F.col("start")).alias("words_from"), (high - low).alias("n_words")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    shard_slots: int = 65_536,
    bucket_docs: int = 20_000,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Plan a mix of all documents.

    Sources in code point order, null last, get ``weights`` in turn. They share ``share`` times all words by
    weight; no target exceeds ``most`` times its source's words, and what a source cannot take the others get
    by weight. A null text has no words. Rows that repeat an id are documents of their own. Other columns are
    ignored. An empty table gives empty results.
    """
    text = whole_text(text_col)
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("tie"),
    )
    sizes = saved(sizes, "mix-sizes")
    sources = saved(_targets(sizes, weights, share, most, block_words), "mix-sources")
    n_docs, n_slots = sources.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    slots = saved(_slots(sources, n_slots, shard_slots, seed), "mix-slots")
    placed, pieces = _placed(sizes, sources, n_docs, block_words, bucket_docs)
    times = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    used = pieces.join(times, ["source_no", "block"])
    used = used.groupBy("source_no", "bucket", "row").agg(F.sum(F.col("times") * F.col("n_words")).alias("taken"))
    taken = placed.join(used, ["source_no", "bucket", "row"], "left").select(
        "doc_id", "tie", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )
    return Mix(sources, slots, pieces, taken)


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """``docs`` with all their columns, each row as often as the mix takes it.

    A document of which the mix takes 1.3 times its words comes once or, with chance 0.3, twice; the choice
    is a function of id, content and ``seed``. Documents without words are not taken.
    """
    taken = mix(docs, seed=seed, **options).taken.where("taken > 0").groupBy("doc_id", "tie").agg(
        F.avg(F.col("taken") / F.col("size")).alias("_times")
    )
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("copies"), "doc_id", "tie"), F.lit(1 << 30)) / float(1 << 30)
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.floor(F.col("_times") + chance).cast("int").alias("_times"))
    rows = docs.withColumn("_text_hash", F.xxhash64(whole_text()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_tie"))
    chosen = rows.join(taken.where("_times > 0"), same)
    chosen = chosen.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return chosen.select(*[F.col(name) for name in docs.columns])
