"""Spelling variants of words by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Bigrams are ordered
by how many words hold them, rarest first. A word's prefix are its three rarest bigrams (and any as frequent as
the third); dynamic programming picks from it the two disjoint bigrams, the pivots, that are rarest together. One
edit leaves one of two disjoint bigrams whole. So if two words are near, a pivot of the one whose prefix ends
earlier in the order is also in the prefix of the other (Deng, Li, Feng: A Pivotal Prefix Based Filtering
Algorithm for String Similarity Search, SIGMOD 2014), and pivots are looked up among prefixes, never words among
words. Positions are limited: a pivot meets a prefix bigram at the same place, counted from the front or from the
back, in words of the lengths that one edit allows, and only together with the half of the word that the edit
spares. So few words meet, however many share a bigram; what meets is verified inside the join.

Null texts have no words; a null id is written as nothing. Equal rows count as often as they come. Words of fewer
than four code points have no two disjoint bigrams in three: they keep their row and have no near words. An empty
table gives an empty result, and other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

#: What a word is made of, and the letters that are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
_EDITS = 1
_GRAM = 2


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, run``: every maximal run of at least ``min_length`` letters, lower-cased from A to Z only."""
    found = F.regexp_extract_all(whole_text(text_col), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("run"))
    return each.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def with_slips(runs: DataFrame, every: int = 31) -> DataFrame:
    """The runs with a code point left out of about one in ``every``, chosen by checksum of document and run."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    h = F.crc32(F.encode(text, "UTF-8"))
    slipped = runs.select("doc_id", "run", h.alias("h"), (h % F.char_length("run")).cast("int").alias("at"))
    without = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
    return slipped.select("doc_id", F.when(F.col("h") % every == 0, without).otherwise(F.col("run")).alias("run"))


def counted(runs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the distinct runs that are long and frequent enough."""
    counts = runs.where(F.char_length("run") >= min_length).groupBy(F.col("run").alias("word"))
    return counts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def pivots(places: list[int], weights: list[int], wanted: int = _EDITS + 1) -> list[int]:
    """The ``wanted`` disjoint grams among ``places`` (rising) with the least weight together, or none."""
    # least[i][j]: the best choice of j among the first i places, as (weight, places).
    least: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * wanted]
    for i, (at, weight) in enumerate(zip(places, weights)):
        clear = i
        while clear and places[clear - 1] > at - _GRAM:
            clear -= 1
        row = [(0, ())]
        for j in range(1, wanted + 1):
            before = least[clear][j - 1]
            ways = [least[i][j], before and (before[0] + weight, (*before[1], at))]
            row.append(min((way for way in ways if way), default=None))
        least.append(row)
    return list(least[-1][wanted][1]) if least[-1][wanted] else []


def pivotal_grams(word: str, held: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of the pivots and of the whole prefix of ``word``; ``held`` says how many words hold a gram."""
    grams = [word[i : i + _GRAM] for i in range(len(word) - _GRAM + 1)]
    order = sorted((held[gram], gram) for gram in grams)
    if len(order) <= _GRAM * _EDITS:
        return [], []
    last = order[_GRAM * _EDITS]
    places = [i for i, gram in enumerate(grams) if (held[gram], gram) <= last]
    return pivots(places, [held[grams[i]] for i in places]), places


def _gram_counts(counts: DataFrame) -> dict[str, int]:
    """How many times each bigram stands in a distinct word.

    There are at most as many as pairs of letters, 8,100 for the letters of :func:`runs`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                held.update(word[i : i + _GRAM] for i in range(len(word) - _GRAM + 1))
        yield pa.RecordBatch.from_pydict({"gram": list(held), "n": pa.array(held.values(), pa.int64())})

    rows = counts.select("word").mapInArrow(count, "gram STRING, n LONG").groupBy("gram").agg(F.sum("n").alias("n"))
    return {row["gram"]: row["n"] for row in rows.collect()}


def found_under(word: str, places: list[int]) -> Iterator[tuple]:
    """The keys under which a word is found: a half of it, and a gram of its prefix with its place."""
    size = len(word)
    half = size // 2
    for at in places:
        gram = word[at : at + _GRAM]
        yield size, "front", word[:half], at, gram
        yield size, "back", word[half:], at - size, gram
        if at >= half:
            yield size, "front", word[:half], at - size, gram
        if at <= half - 2:
            yield size, "back", word[half:], at, gram


def looked_up(word: str, i: int, j: int) -> Iterator[tuple[tuple, int]]:
    """The keys under which the near words of a word with pivots at i and j are found.

    Near words share all but one code point from the two ends together, so they share the front half or the back
    half of the other word. Of the two pivots one that the edit spares is looked up with it, at its place from the
    front if the edit is behind it, else at its place from the back. With each key comes a cut of the word inside
    the other half: a near word begins with what is before the cut or ends with what is behind it.
    """
    size = len(word)
    for other in (size - 1, size, size + 1):
        half = other // 2
        front, back = word[:half], word[size - (other - half) :]
        first, second = word[i : i + _GRAM], word[j : j + _GRAM]
        behind, before = (half + size) // 2, (size - len(back)) // 2
        yield (other, "front", front, i, first), behind
        if i + _GRAM > half:
            yield (other, "front", front, j - size, second), behind
        yield (other, "back", back, j - size, second), before
        if size - j > other - half:
            yield (other, "back", back, i, first), before


def _keys(counts: DataFrame) -> DataFrame:
    """``word, n, key, head, tail``: the hashed keys each word asks for, and, without head, is found under."""
    held = counts.sparkSession.sparkContext.broadcast(_gram_counts(counts))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chosen, places = pivotal_grams(word, held.value)
                if chosen:
                    rows += [(word, n, _hashed(key), None, None) for key in found_under(word, places)]
                    rows += [(word, n, _hashed(key), word[:cut], word[cut:]) for key, cut in looked_up(word, *chosen)]
            columns = list(zip(*rows)) or [()] * len(_KEYS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEYS)], schema=_KEYS)

    return counts.select("word", "n").mapInArrow(part, "word STRING, n LONG, key LONG, head STRING, tail STRING")


def _hashed(key: tuple) -> int:
    # Different keys with one hash only bring words together that are then found not to be near.
    return xxhash.xxh64_intdigest(repr(key)) - (1 << 63)


_KEYS = pa.schema(
    [("word", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("head", pa.string()), ("tail", pa.string())]
)


def near_pairs(counts: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every two near words, in either order. ``counts`` has one row a word."""
    keys = saved(_keys(counts), "pivotal-grams")
    mine = keys.where("head IS NOT NULL")
    theirs = keys.where("head IS NULL").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = (F.startswith("other", "head") | F.endswith("other", "tail")) & (F.levenshtein("word", "other", _EDITS) == _EDITS)
    found = mine.join(theirs, (mine["key"] == theirs["key"]) & near).select("word", "n", "other", "other_n")
    # A pair may be found from either side and under several grams.
    back = F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = F.array(F.struct("word", "n", "other", "other_n"), back)
    return found.select(F.explode(both).alias("pair")).select("pair.*").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``forms (word, form)`` lead in the end.

    Each round doubles the steps taken. A form is ``RATIO`` times as frequent as its word, so chains are short.
    """
    steps = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.join(onward, "root", "left")
        moved = saved(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``counts (word, n)``.

    ``form`` is the near word of largest n, of equal ones the first in code point order, if that n is at least
    ``ratio`` times the word's, otherwise null; ``root`` follows forms to the last.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, or they may lead in a circle")
    counts = saved(counts.select("word", "n"), "spelling-words")
    largest = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_pairs(counts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), largest.alias("best"))
    enough: Column = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    judged = counts.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    judged = saved(judged, "spelling-forms")
    roots = _roots(judged.where("form IS NOT NULL"))
    named = judged.join(roots, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
