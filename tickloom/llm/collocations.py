"""Phrases of two to four words that occur together, by mergeable Misra-Gries summaries and an exact second count.

Texts are cut into pieces at punctuation and line ends and these into words. First, the words and word pairs of
each slice of the corpus go as counted hashes to hash partitions. A partition merges them into one Misra-Gries
summary (Agarwal et al.: Mergeable Summaries, PODS 2012): counters are added, and when there are more than the
capacity, all lose the largest count that none of the excess exceeds. What a counter has lost in all stays below
mass / (capacity + 1), and the capacity is the partition's mass divided by the threshold, so every phrase as
frequent as the threshold keeps a counter. Longer phrases follow in the same way, but only those whose pairs have
all survived. A last pass counts the survivors exactly, by their words.

What survives reaches the tasks as a bit map of ``FILTER_BYTES`` at any size of the corpus. Phrases that share a
bit or a hash with a survivor are counted in vain and then found too rare, so nothing depends on hashes but speed.

Null texts are empty and a null language is ``und``. Equal rows count as often as they come. Texts of any length
are whole in a slice. An empty table gives an empty result, and other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, saved, whole_text

THRESHOLD, LONGEST, TOP = 30, 4, 2000
FILTER_BYTES = 16 << 20
#: Bytes of text for each hash partition; a partition holds some words and pairs of it as eight bytes at most.
PARTITION_BYTES = 16 << 20

#: The bytes that end a piece, those between words, and the letters that are lower-cased.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(SPACES)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_Grams = tuple[int, np.ndarray, np.ndarray]


@dataclass
class Words:
    """The words of some texts in order, by number; ``piece`` and ``lang`` say where each stands."""

    names: pa.Array
    number: np.ndarray
    hashed: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]

    @staticmethod
    def of(texts: pa.Array, langs: pa.Array) -> Words:
        coded = langs.dictionary_encode()
        raw = np.frombuffer("\n".join(texts.to_pylist()).encode(), dtype=np.uint8)
        kind = _KIND[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        letters = _LOWER[raw[inside[1:-1]]]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
        words = words.dictionary_encode()
        names = words.dictionary
        hashed = np.array([xxhash.xxh64_intdigest(name) for name in names.to_pylist()], dtype=np.uint64)
        tongues = coded.dictionary.to_pylist()
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
        begin = np.cumsum(sizes) - sizes
        text = np.searchsorted(begin, starts, side="right") - 1
        return Words(
            names,
            words.indices.to_numpy().astype(np.int64),
            hashed,
            np.searchsorted(np.flatnonzero(kind == 2), starts),
            coded.indices.to_numpy()[text].astype(np.int64),
            tongues,
        )

    def together(self, size: int) -> np.ndarray:
        """Whether a phrase of ``size`` words starts at each word that has as many from it on."""
        n = len(self.piece) - size + 1
        return self.piece[: max(n, 0)] == self.piece[size - 1 :][: max(n, 0)]

    def gram_hashes(self, size: int) -> np.ndarray:
        seeds = np.array([xxhash.xxh64_intdigest(lang, size) for lang in self.langs], dtype=np.uint64)
        n = max(len(self.piece) - size + 1, 0)
        total = seeds[self.lang[:n]] if n else np.zeros(0, np.uint64)
        for place in range(size):
            total = (total ^ self.hashed[self.number[place : place + n]]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return total


class Survivors:
    """One bit map for all partitions; each has its share of the bits."""

    def __init__(self, partitions: int, most_bytes: int = FILTER_BYTES):
        self.partitions = partitions
        self.share = max(1, most_bytes // partitions)
        self.map = np.zeros(self.share * partitions, dtype=np.uint8)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Where keys of 32 bits stand among the bits of their partition."""
        return keys.astype(np.uint64) * np.uint64(self.share * 8) >> np.uint64(32)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        part, key = placed(hashes, self.partitions)
        bit = part * np.uint64(self.share * 8) + self.bits(key)
        return (self.map[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def placed(hashes: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition and key of each hash."""
    return (hashes >> np.uint64(32)) % np.uint64(partitions), hashes & np.uint64(0xFFFFFFFF)


def reduce_summary(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of at most ``capacity`` counters, and how much each counter has lost."""
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > cut
    return keys[left], counts[left] - cut, cut


def merge_summaries(
    summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """The summary of all, and the most that any counter has lost: at most mass / (capacity + 1)."""
    keys, counts, lost = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for i, summary in enumerate(summaries):
        waiting.append(summary)
        size += len(summary[0])
        if size > capacity or i + 1 == len(summaries):
            joined = np.concatenate([keys, *[k for k, _ in waiting]])
            keys, at = np.unique(joined, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, *[c for _, c in waiting]]), len(keys)).astype(np.int64)
            keys, counts, cut = reduce_summary(keys, counts, capacity)
            lost, waiting, size = lost + cut, [], 0
    return keys, counts, lost


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in bounded(batch, 0):
            yield Words.of(part.column(0), part.column(1))


def _survivors(texts: DataFrame, hashes: Callable[[Words], list[np.ndarray]], partitions: int, threshold: int) -> Survivors:
    """The phrases among ``hashes`` of each slice that may be as frequent as the threshold."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _sliced(batches):
            part, key = placed(np.concatenate(hashes(words)), partitions)
            both, counts = np.unique(part << np.uint64(32) | key, return_counts=True)
            number = (both >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(number)) + 1
            rows = [(int(number[lo]), both[lo:hi].astype(np.uint32), counts[lo:hi].astype(np.uint32)) for lo, hi in zip([0, *cuts], [*cuts, len(both)]) if lo < hi]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, *_ in rows], pa.int32()),
                    pa.array([k.tobytes() for _, k, _ in rows], pa.binary()),
                    pa.array([c.tobytes() for *_, c in rows], pa.binary()),
                ],
                ["part", "keys", "counts"],
            )

    empty = Survivors(partitions)

    def merge(group: pa.Table) -> pa.Table:
        number = group.column("part")[0].as_py()
        held = zip(group.column("keys"), group.column("counts"))
        # Counts pass through bincount as doubles: exact up to 2**53 occurrences in a partition.
        summaries = [(np.frombuffer(k.as_buffer(), np.uint32), np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64)) for k, c in held]
        mass = int(sum(counts.sum() for _, counts in summaries))
        keys, counts, lost = merge_summaries(summaries, max(1, mass // threshold))
        keys = keys[counts + lost >= threshold]
        share = np.zeros(empty.share, dtype=np.uint8)
        bit = empty.bits(keys)
        np.bitwise_or.at(share, bit >> np.uint64(3), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        return pa.table({"part": pa.array([number], pa.int32()), "bits": pa.array([share.tobytes()], pa.binary())})

    summaries = texts.mapInArrow(summarise, "part INT, keys BINARY, counts BINARY")
    # All rows together are as large as the bit map.
    for row in summaries.groupBy("part").applyInArrow(merge, "part INT, bits BINARY").toLocalIterator():
        empty.map[row["part"] * empty.share :][: empty.share] = np.frombuffer(row["bits"], np.uint8)
    return empty


def _frequent(words: Words, size: int, short: Survivors) -> np.ndarray:
    """Which starts of phrases of ``size`` words have only pairs that survived."""
    pairs = words.together(2)
    pairs[pairs] = short.holds(words.gram_hashes(2)[pairs])
    n = max(len(words.piece) - size + 1, 0)
    good = words.together(size)
    for place in range(size - 1):
        good &= pairs[place : place + n]
    return good


def _counted(words: Words, size: int, good: np.ndarray) -> _Grams:
    """``(size, first place, count)`` of each different phrase that starts where ``good``, told apart by its words."""
    at = np.flatnonzero(good)
    same = words.lang[at]
    for place in range(size):
        _, same = np.unique(same * len(words.names) + words.number[at + place], return_inverse=True)
    _, first, counts = np.unique(same, return_index=True, return_counts=True)
    return size, at[first], counts


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, size, phrase, f``: every phrase of one to ``longest`` words that occurs ``threshold`` times in a language.

    The row of size 0 has the number of all words of the language.
    """
    texts = docs.select(whole_text(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    context = docs.sparkSession.sparkContext
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    partitions = max(12, math.ceil(size / PARTITION_BYTES))
    short = context.broadcast(
        _survivors(texts, lambda w: [w.gram_hashes(1), w.gram_hashes(2)[w.together(2)]], partitions, threshold)
    )
    lengths = range(3, longest + 1)
    long = context.broadcast(
        _survivors(texts, lambda w: [w.gram_hashes(n)[_frequent(w, n, short.value)] for n in lengths], partitions, threshold)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _sliced(batches):
            grams = [_counted(words, 1, short.value.holds(words.gram_hashes(1)))]
            for n in range(2, longest + 1):
                good = _frequent(words, n, short.value)
                if n > 2:
                    good[good] = long.value.holds(words.gram_hashes(n)[good])
                grams.append(_counted(words, n, good))
            langs = pa.array(words.langs, pa.string())
            totals = np.bincount(words.lang, minlength=len(words.langs))
            yield _rows(langs, np.zeros(len(langs), np.int32), pa.nulls(len(langs), pa.string()), totals)
            for n, at, counts in grams:
                parts = [words.names.take(pa.array(words.number[at + place])) for place in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield _rows(langs.take(pa.array(words.lang[at])), np.full(len(at), n, np.int32), phrase, counts)

    def _rows(lang: pa.Array, size: np.ndarray, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
        columns = [lang, pa.array(size), phrase, pa.array(f.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])

    counted = texts.mapInArrow(count, "lang STRING, size INT, phrase STRING, f LONG")
    exact = counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return exact.where((F.col("size") == 0) | (F.col("f") >= threshold))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase that occurs a times is cut where the parts, l and r times frequent, make it the least surprising:
    score is floor(2,000,000 a / (l + r)) at the cut with the smallest, of equal ones the first. Phrases of which at
    least 80 % lie inside one longer phrase drop out.
    """
    spark = docs.sparkSession
    counts = saved(phrase_counts(docs, threshold, longest, text_col, lang_col), "phrases")
    known = counts.where("size > 0").select("lang", "phrase", "f")
    phrases = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    def piece(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    cuts = F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.struct(k.alias("k"), piece(F.lit(1), k).alias("first"), piece(k + 1, F.col("size") - k).alias("rest")),
    )
    cut = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = "CAST(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS LONG)"
    scored = cut.select("lang", "phrase", "a", F.struct(F.expr(exact).alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda length: F.transform(F.sequence(F.lit(1), F.col("size") - length + 1), lambda start: piece(start, length)),
        )
    )
    inside = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = "longer IS NOT NULL AND CAST(longer AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * 80"
    left = scored.join(inside, ["lang", "phrase"], "left").where(f"NOT ({covered})")

    order = (F.desc("cut.score"), F.desc("a"), "phrase")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    best = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
