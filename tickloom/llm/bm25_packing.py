"""Fixed windows of token ids, filled with lexically similar documents.

Documents are dealt to shards of about ``shard_tokens`` ids by a hash of their identity. Each shard builds a
BM25 inverted index over token ids; document frequencies and the mean length come from all documents, so the
scores do not depend on the shard. A seed document opens a window, the index ranks the unused documents of
the shard by BM25 against all distinct ids of the seed, and they fill the window in that order. The document
that does not fit is cut, and its remainder seeds the next window. A seed longer than a window first fills
windows of its own. So all windows of a shard are full except the last, whose content is divided into
sequences of powers of two, which need no padding.

Memory of a task is that of one shard. The only thing gathered from all documents is one count for each entry
of the vocabulary, whose size is fixed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, bounded, releasing, saved, whole_text
from .token_ids import encoder, with_end

#: Usual BM25 constants.
K1, B = 1.2, 0.75
ENCODED = "doc_id LONG, n LONG, ids BINARY"
PIECES = (
    "doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, sequence_id LONG, `offset` LONG, "
    "sequence_length LONG, ids ARRAY<INT>"
)


def encoded(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Ids of every document with ``end_id`` behind them, two bytes each where all of them fit."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, 1)):
            ids, bounds = with_end(*encoder(tokenizer, spaces).batch(batch.column(1)), end_id)
            ids = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
            rows = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            counts = pa.array(np.diff(bounds), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(rows, pa.binary())], ["doc_id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: releasing(encode(batches)), ENCODED)


def pack(
    docs: DataFrame,
    tokenizer: str,
    spaces: str = "dropped",
    end_id: int = 2,
    window: int = 4096,
    shard_tokens: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: which ids of which document stand where in which sequence, and the ids.

    A null text is empty: its piece is the end id alone. Rows that repeat a document id are packed like any
    other row. An empty table gives no pieces. Other columns are ignored. Ties of scores go to the smaller
    document id, so that reruns agree.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    table = saved(encoded(docs, tokenizer, spaces, end_id, id_col, text_col), "packing-ids", TEXT_ROWS)
    n_docs, n_ids = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = table.mapInArrow(lambda batches: releasing(_document_counts(batches)), "term LONG, docs LONG").groupBy("term").agg(F.sum("docs").alias("docs"))
    rows = found.collect()  # a row for each entry of the vocabulary at most
    frequency = np.zeros(max([row.term for row in rows], default=0) + 1)
    for row in rows:
        frequency[row.term] = row.docs
    rarity = spark.sparkContext.broadcast(np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5)))
    mean = n_ids / max(n_docs, 1)
    shards = max(1, -(-n_ids // shard_tokens))
    shard = F.pmod(F.xxhash64("doc_id", F.xxhash64("ids")), F.lit(shards)).alias("shard")

    def fill(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _shard(key[0].as_py(), group, rarity.value, mean, window)

    return table.select(shard, "*").groupBy("shard").applyInArrow(fill, PIECES)


def _rows_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in a row, and the number of ids of each document."""
    counts = batch.column("n").to_numpy()
    rows = batch.column("ids").to_pylist()
    flat = b"".join(rows)
    if len(flat) == 2 * counts.sum():  # all of them two bytes each
        return np.frombuffer(flat, "<u2").astype(np.int64), counts
    parts = [
        np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)
        for raw, n in zip(rows, counts)
    ]
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), counts


def _pairs(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Document and term of every id in one number, in four bytes if that is enough: those sort faster."""
    kind = np.uint32 if len(counts) * size < 1 << 32 else np.int64
    return np.repeat(np.arange(len(counts), dtype=kind) * kind(size), counts) + ids.astype(kind)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in (part for whole in batches for part in bounded(whole, 2, 2 << 20)):
        ids, counts = _rows_of(batch)
        if not len(ids):
            continue
        size = int(ids.max()) + 1
        # Sorted in place: np.unique hashes them, which takes several times as long.
        pairs = _pairs(ids, counts, size)
        pairs.sort()
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
        here = np.bincount(pairs % size, minlength=len(total))
        here[: len(total)] += total
        total = here
    terms = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(total[terms], pa.int64())], ["term", "docs"])


class Index:
    """Postings of one shard: for each term its documents and their BM25 weights."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, rarity: np.ndarray, mean: float) -> None:
        size = len(rarity)
        self.n = len(counts)
        pairs, times = np.unique(_pairs(ids, counts, size), return_counts=True)
        doc, term = (pairs // size).astype(np.int64), (pairs % size).astype(np.int64)
        weight = rarity[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * counts[doc] / mean))
        order = np.argsort(term.astype(np.uint16) if size <= 1 << 16 else term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(size + 1))
        self.terms, self.cuts = term, np.searchsorted(doc, np.arange(self.n + 1))
        self.free = self.n

    def _drop(self, used: np.ndarray) -> None:
        """Take the used documents out of the postings; nothing asks for their scores again."""
        kept = ~used[self.docs]
        before = np.concatenate(([0], np.cumsum(kept)))
        self.docs, self.weights, self.begin = self.docs[kept], self.weights[kept], before[self.begin]

    def ranked(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents, best score first; those that share no term with the seed come last."""
        free = self.n - np.count_nonzero(used)
        if free < 0.9 * self.free:
            self._drop(used)
            self.free = free
        terms = self.terms[self.cuts[seed] : self.cuts[seed + 1]]
        lo, hi = self.begin[terms], self.begin[terms + 1]
        each = hi - lo
        at = np.arange(each.sum()) + np.repeat(lo - (np.cumsum(each) - each), each)
        scores = np.bincount(self.docs[at], self.weights[at], self.n)
        free = np.flatnonzero(~used)
        return free[np.argsort(-scores[free], kind="stable")]


def _shard(shard: int, group: pa.Table, rarity: np.ndarray, mean: float, window: int) -> pa.Table:
    # The order of the rows decides ties: by id, null first, then by content.
    keys = [(-1 if i is None else 0, i or 0, raw) for i, raw in zip(group["doc_id"].to_pylist(), group["ids"].to_pylist())]
    group = group.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__)))
    ids, counts = _rows_of(group)
    first = np.concatenate(([0], np.cumsum(counts)))
    sequences = _fill(Index(ids, counts, rarity, mean), counts, window)
    doc_ids, small_ids = group["doc_id"].to_pylist(), ids.astype("<u4")
    rows, order, lengths = [], [], []
    for k, pieces in enumerate(sequences):
        offset, total = 0, sum(length for _, _, length in pieces)
        for doc, start, length in pieces:
            piece = small_ids[first[doc] + start : first[doc] + start + length]
            rows.append((doc_ids[doc], start, length, zlib.crc32(piece), int(counts[doc]), (shard << 32) + k, offset, total))
            order.append(piece)
            lengths.append(length)
            offset += length
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")
    columns = {name: pa.array(values, pa.int64()) for name, values in zip(names, zip(*rows))}
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    flat = pa.array(np.concatenate(order).view(np.int32))
    return pa.table(columns | {"ids": pa.ListArray.from_arrays(pa.array(ends), flat)})


def _fill(index: Index, counts: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, first id, number of ids)."""
    used = np.zeros(len(counts), bool)
    sequences: list[list[tuple[int, int, int]]] = []
    open_: list[tuple[int, int, int]] = []
    seed, done, scan = None, 0, 0
    while True:
        if seed is None:
            while scan < len(counts) and used[scan]:
                scan += 1
            if scan == len(counts):
                break
            seed, done = scan, 0
            used[seed] = True
        left = int(counts[seed]) - done
        while left >= window:
            sequences.append([(seed, done, window)])
            done, left = done + window, left - window
        if not left:
            seed = None
            continue
        open_, room = [(seed, done, left)], window - left
        last, seed = seed, None
        for other in index.ranked(last, used):
            used[other] = True
            take = min(int(counts[other]), room)
            open_.append((int(other), 0, take))
            room -= take
            if not room:
                if take < counts[other]:
                    seed, done = int(other), take
                break
        if room:
            break
        sequences.append(open_)
        open_ = []
    return sequences + _powers_of_two(open_)


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same ids in sequences whose lengths are the powers of two that add up to their number."""
    out, pieces = [], list(reversed(pieces))
    total = sum(length for _, _, length in pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        sequence = []
        while size:
            doc, start, length = pieces.pop()
            take = min(length, size)
            sequence.append((doc, start, take))
            size -= take
            if take < length:
                pieces.append((doc, start + take, length - take))
        out.append(sequence)
    return out
