"""Scoring texts by prediction by partial matching, beside a unigram base.

The model is a trie of byte contexts up to ``ORDER`` bytes, counted over all training documents; a text starts
after padding and ends with an end symbol. The probability of a symbol is its share in the longest context that
the training data know, with method C's escape estimate (distinct symbols over distinct symbols plus count);
on an escape the next shorter context is asked, without the symbols that were possible in the longer one
(symbol exclusion); below order zero all symbols left are equally likely. So all that a text needs are the
probabilities of its distinct runs of ``ORDER + 1`` symbols.

Documents are dealt to chunks of about ``chunk_bytes``. A chunk hands in its distinct words and runs with their
training counts; these are summed over all documents, and probabilities are computed for groups of runs that
share their last two context symbols: such a group holds the trie below that context, contexts of one symbol
and none come as a table of fixed size. The values then go back to the chunks that asked. So no task and no
broadcast holds the whole trie or vocabulary, and what a chunk receives is bounded by its own text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

ORDER = 4
START, END, SYMBOLS = 256, 257, 257  # the start is never predicted
BITS = 9
FEATURES = "chunk LONG, word BINARY, place LONG, gram LONG, n LONG"
SCORES = "doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, base_score DOUBLE, score DOUBLE"
_BLOCK = 2_000_000


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ORDER + 1`` symbols of all texts in a row, one ending at each byte and at the end of each text,
    and where each text's begin."""
    pad = np.full(ORDER, START, np.int64)
    parts, ends = [], 0
    bounds = [0]
    for text in texts:
        parts += [pad, np.frombuffer(text, np.uint8).astype(np.int64), np.array([END])]
        ends += len(text) + 1
        bounds.append(ends)
    row = np.concatenate(parts) if parts else np.empty(0, np.int64)
    if not len(row):
        return row, np.array(bounds)
    gram = np.zeros(len(row) - ORDER, np.int64)
    for at in range(ORDER + 1):
        gram = (gram << BITS) | row[at : len(row) - ORDER + at]
    # Runs that end in the padding of the next text do not count.
    keep = row[ORDER:] != START
    return gram[keep], np.array(bounds)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about ``_BLOCK`` bytes together."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text) + 1
        if held >= _BLOCK:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: ASCII letters and white space


def _collect(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Distinct words and runs of a chunk with their counts in training documents."""
    texts = [text.encode() for text in group["text"].to_pylist()]
    train = ~group["held_out"].to_numpy()
    words: Counter[bytes] = Counter()
    others: set[bytes] = set()
    for text, counted in zip(texts, train):
        (words.update if counted else others.update)(_words(text))
    vocabulary = sorted(others | words.keys())
    found, counts = [], []
    for a, b in _blocks(texts):
        grams, bounds = grams_of(texts[a:b])
        codes, distinct = pd.factorize(grams)
        weight = np.repeat(train[a:b].astype(np.float64), np.diff(bounds))
        found.append(distinct)
        counts.append(np.bincount(codes, weight, len(distinct)))
    distinct, at = np.unique(np.concatenate(found), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
    n_words, n_grams = len(vocabulary), len(distinct)
    return pa.table(
        {
            "chunk": pa.repeat(key[0], n_words + n_grams),
            "word": pa.chunked_array([pa.array(vocabulary, pa.binary()), pa.nulls(n_grams, pa.binary())]),
            "place": pa.chunked_array([pa.array(np.arange(n_words)), pa.nulls(n_grams, pa.int64())]),
            "gram": pa.chunked_array([pa.nulls(n_words, pa.int64()), pa.array(distinct)]),
            "n": pa.array(np.concatenate([np.fromiter((words[w] for w in vocabulary), np.int64, n_words), total])),
        }
    )


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each row's key among them, and the sums of ``n``."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at, np.bincount(at, n, len(distinct))


def _lookup(distinct: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values of the keys, 0 for those not there."""
    if not len(distinct):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
    return np.where(distinct[at] == keys, values[at], 0.0)


class Level:
    """Counts of one context length: children, and what of them the next longer contexts exclude."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> None:
        self.pairs, _, self.times = _sums((context << BITS) | symbol, n)
        owner = self.pairs >> BITS
        self.contexts, at, self.total = _sums(owner, self.times)
        self.kinds = np.bincount(at, minlength=len(self.contexts)).astype(np.float64)

    def count(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return _lookup(self.pairs, self.times, (context << BITS) | symbol)


def log_probabilities(gram: np.ndarray, n: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 of the probability of the last symbol of each run after the ones before it.

    ``gram`` has all runs known for the contexts in question (those that share their last two context symbols),
    ``n`` their training counts, 0 for runs that only occur elsewhere. ``low`` has the levels of no and of one
    context symbol.
    """
    symbol, context = gram & ((1 << BITS) - 1), gram >> BITS
    seen = n > 0
    levels = list(low)
    for length in range(2, ORDER + 1):
        suffix = context[seen] & ((1 << (BITS * length)) - 1)
        levels.append(Level(suffix, symbol[seen], n[seen].astype(np.float64)))
    score = np.zeros(len(gram))
    open_ = np.ones(len(gram), bool)
    above_kinds = np.zeros(len(gram))
    above: Level | None = None
    for length in range(ORDER, -1, -1):
        level = levels[length]
        own = context & ((1 << (BITS * length)) - 1)
        total, kinds = _lookup(level.contexts, level.total, own), _lookup(level.contexts, level.kinds, own)
        if above is not None:
            # Children of the longer context are children here too; their counts here do not take part.
            longer, child = above.pairs >> BITS, above.pairs & ((1 << BITS) - 1)
            here = level.count(longer & ((1 << (BITS * length)) - 1), child)
            contexts, _, excluded = _sums(longer, here)
            wide = context & ((1 << (BITS * (length + 1))) - 1)
            total = total - _lookup(contexts, excluded, wide)
            kinds = kinds - above_kinds
        times = level.count(own, symbol)
        whole = total + kinds
        hit = open_ & (times > 0)
        score[hit] += np.log10(times[hit] / whole[hit])
        open_ &= ~hit
        escape = open_ & (kinds > 0)
        score[escape] += np.log10(kinds[escape] / whole[escape])
        above, above_kinds = level, _lookup(level.contexts, level.kinds, own)
    score[open_] -= np.log10(SYMBOLS - above_kinds[open_])
    return score


def _score(docs: pa.Table, values: pa.Table, n_train: int, n_tokens: int, n_kinds: int) -> pa.Table:
    """Scores of a chunk's documents from the values of its words and runs."""
    texts = [text.encode() for text in docs["text"].to_pylist()]
    places, grams = values["place"], values["gram"]
    is_word = places.is_valid().to_numpy()
    found = values["value"].to_numpy()
    counts = np.zeros(int(is_word.sum()))
    counts[places.filter(pa.array(is_word)).to_numpy()] = found[is_word]
    runs, logs = grams.filter(pa.array(~is_word)).to_numpy(), found[~is_word]
    order = np.argsort(runs)
    runs, logs = runs[order], logs[order]
    whole = math.log10(n_tokens + 0.1 * (n_kinds + 1))
    vocabulary = sorted({word for text in texts for word in _words(text)})
    base = dict(zip(vocabulary, (np.log10(counts + 0.1) - whole).tolist()))
    known = dict(zip(vocabulary, (counts > 0).tolist()))
    end = math.log10(n_train + 0.1) - whole
    rows = []
    for text in texts:
        words = _words(text)
        rows.append((len(words) + 1, sum(map(known.__getitem__, words)) + (n_train > 0), sum(map(base.__getitem__, words)) + end))
    scores = []
    for a, b in _blocks(texts):
        own, bounds = grams_of(texts[a:b])
        codes, distinct = pd.factorize(own)
        each = logs[np.searchsorted(runs, distinct)][codes]
        scores.append(np.add.reduceat(each, bounds[:-1]))
    return pa.table(
        {
            "doc_id": docs["doc_id"], "held_out": docs["held_out"],
            "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "n_known": pa.array([r[1] for r in rows], pa.int64()),
            "base_score": pa.array([r[2] for r in rows], pa.float64()), "score": pa.array(np.concatenate(scores), pa.float64()),
        }
    )


def held_out_tenth(id_col: str) -> Column:
    """True for documents whose CRC-32 of the id as text ends in 0; null ids are training documents."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def score_documents(
    docs: DataFrame,
    held_out: Column | None = None,
    chunk_bytes: int = 8 << 20,
    group_runs: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from documents that are not ``held_out`` (by default :func:`held_out_tenth`) and scores all of them.
    ``base_score`` is the unigram score over words, lower-cased in ASCII, and one end; ``score`` is log10 of the
    model's probability of the text's bytes and its end. A null text is empty. Repeated rows are scored like
    others; other columns are ignored; an empty table gives no rows. Without training documents all words are
    unknown and all bytes equally likely.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (held_out_tenth(id_col) if held_out is None else held_out).alias("held_out"),
        text.alias("text"),
    )
    size, n_train = rows.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))
    ).first()
    chunks = max(1, -(-size // chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    rows = rows.repartition(chunks, "chunk")
    features = saved(rows.groupBy("chunk").applyInArrow(_collect, FEATURES), "ppm-features")

    asked_words = features.where("word IS NOT NULL").select("chunk", "word", "place", "n")
    words = saved(asked_words.groupBy("word").agg(F.sum("n").alias("value")), "ppm-words")
    n_words, n_kinds = words.agg(F.coalesce(F.sum("value"), F.lit(0)), F.count(F.when(F.col("value") > 0, 1))).first()
    n_tokens, n_kinds = n_words + n_train, n_kinds + (n_train > 0)

    asked_runs = features.where("gram IS NOT NULL").select("chunk", "gram", "n")
    runs = saved(asked_runs.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-runs")
    symbol, last = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1)), F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    pairs = runs.where("n > 0").groupBy(last.alias("c"), symbol.alias("s")).agg(F.sum("n").alias("n")).toPandas()
    c, s, n = (pairs[name].to_numpy(np.int64) for name in ("c", "s", "n"))  # at most 258 x 258
    shared = docs.sparkSession.sparkContext.broadcast([Level(np.zeros_like(c), s, n.astype(float)), Level(c, s, n.astype(float))])
    groups = max(1, -(-runs.count() // group_runs))
    suffix = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << (2 * BITS)) - 1))

    def values(group: pa.Table) -> pa.Table:
        gram, n = group["gram"].to_numpy(), group["n"].to_numpy()
        return pa.table({"gram": gram, "value": log_probabilities(gram, n, shared.value)})

    valued = runs.groupBy(F.pmod(F.xxhash64(suffix), F.lit(groups)).alias("part")).applyInArrow(values, "gram LONG, value DOUBLE")
    valued = saved(valued, "ppm-values")
    answers = asked_words.join(words, "word").select("chunk", "place", F.lit(None).cast("long").alias("gram"), F.col("value").cast("double"))
    answers = answers.unionByName(
        asked_runs.join(valued, "gram").select("chunk", F.lit(None).cast("long").alias("place"), "gram", "value")
    )

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        return _score(own, found, n_train, n_tokens, n_kinds)

    scored = rows.groupBy("chunk").cogroup(answers.repartition(chunks, "chunk").groupBy("chunk")).applyInArrow(score, SCORES)
    return scored.withColumn("train_tokens", F.lit(n_tokens).cast("long"))
