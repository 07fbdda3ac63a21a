"""Token ids in files of compressed bit planes.

A file holds the documents of one range of ids. Their token ids stand in a row, cut into blocks of
``block_ids``; the last block may be shorter. Each block is transposed: plane k holds bit (or byte) k of
every id of the block, and is compressed with zstandard on its own. Planes above the highest one in use are
not stored. Layout, all numbers little-endian::

    magic | planes of block 0 | planes of block 1 | ... | footer | u64 length of the footer | magic

The footer is a zstandard frame of JSON: the chunk index (ids, first byte and plane sizes of every block),
the plane kind, and the documents with their token counts. A reader that wants ids ``lo`` to ``hi`` reads the
blocks which hold them and no others.

Writing is a range shuffle on the document id, a sort, and one file a task. A file counts once the manifest
table lists it; that table is written by Spark's commit protocol, so what a failed or repeated attempt left
behind is never read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, file_system, whole_text
from .token_ids import encoder, with_end

MAGIC = b"IDPLANE1"
MANIFEST = "part LONG, file STRING, n_ids LONG, n_docs LONG, n_bytes LONG"
READ = "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG, ids ARRAY<LONG>"


def planes_of(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of one block, lowest first, without the empty ones above the highest in use."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        used = (int(ids.max(initial=0)).bit_length() + 7) // 8
        return [cells[:, k].tobytes() for k in range(used)]
    used = int(ids.max(initial=0)).bit_length()
    bits = np.unpackbits(cells[:, : (used + 7) // 8], axis=1, bitorder="little")[:, :used]
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return [row.tobytes() for row in packed]


def ids_of(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The ids of a block from its planes."""
    cells = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            cells[:, k] = np.frombuffer(plane, np.uint8)
    elif planes:
        rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
        bits = np.unpackbits(rows, axis=1, bitorder="little", count=n).T
        packed = np.packbits(bits, axis=1, bitorder="little")
        cells[:, : packed.shape[1]] = packed
    return cells.view("<u4").reshape(n)


class PlaneWriter:
    """Appends documents to one file, block by block."""

    def __init__(self, stream, block_ids: int, kind: str, level: int) -> None:
        self.stream, self.block_ids, self.kind = stream, block_ids, kind
        self.press = zstandard.ZstdCompressor(level=level)
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.at = len(MAGIC)
        stream.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        self.docs += doc_ids
        self.counts += np.diff(bounds).tolist()
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            row = np.concatenate(self.rest)
            whole = len(row) - len(row) % self.block_ids
            for lo in range(0, whole, self.block_ids):
                self._block(row[lo : lo + self.block_ids])
            self.rest, self.waiting = [row[whole:].copy()], len(row) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.press.compress(plane) for plane in planes_of(ids, self.kind)]
        self.index.append((len(ids), self.at, [len(plane) for plane in packed]))
        for plane in packed:
            self.stream.write(plane)
            self.at += len(plane)

    def close(self) -> tuple[int, int, int]:
        """Ids, documents and bytes of the finished file."""
        if self.waiting:
            self._block(np.concatenate(self.rest))
        footer = {"kind": self.kind, "block_ids": self.block_ids, "index": self.index}
        footer |= {"doc_ids": self.docs, "n_tokens": self.counts}
        packed = self.press.compress(json.dumps(footer, separators=(",", ":")).encode())
        self.stream.write(packed + struct.pack("<Q", len(packed)) + MAGIC)
        return sum(self.counts), len(self.docs), self.at + len(packed) + 16


class PlaneReader:
    """Reads a file through its chunk index."""

    def __init__(self, stream) -> None:
        self.stream = stream
        size = stream.size()
        tail = stream.read_at(16, size - 16)
        if tail[8:] != MAGIC or stream.read_at(8, 0) != MAGIC:
            raise ValueError("not a finished plane file")
        length = struct.unpack("<Q", tail[:8])[0]
        unpack = zstandard.ZstdDecompressor()
        self.footer = json.loads(unpack.decompress(stream.read_at(length, size - 16 - length)))
        self.unpack = unpack

    def block(self, k: int) -> np.ndarray:
        n, at, sizes = self.footer["index"][k]
        raw = self.stream.read_at(sum(sizes), at)
        cuts = np.concatenate(([0], np.cumsum(sizes))).astype(int)
        planes = [self.unpack.decompress(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return ids_of(planes, n, self.footer["kind"])

    def between(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` (exclusive) of the file."""
        step, blocks = self.footer["block_ids"], len(self.footer["index"])
        first, last = lo // step, min(-(-hi // step), blocks)
        parts = [self.block(k) for k in range(first, last)]
        row = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        return row[lo - first * step : hi - first * step]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, first position and ids of each document; one block is held beside the document's own."""
        at, block, held = 0, 0, np.empty(0, np.uint32)
        for doc_id, n in zip(self.footer["doc_ids"], self.footer["n_tokens"]):
            parts, missing = [], n
            while missing > len(held):
                parts.append(held)
                missing -= len(held)
                held = self.block(block)
                block += 1
            parts.append(held[:missing])
            held = held[missing:]
            yield doc_id, at, np.concatenate(parts)
            at += n


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    spaces: str = "joined",
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = 65_536,
    kind: str = "bit",
    level: int = 3,
) -> None:
    """Encode every text, put ``end_id`` after it and write all ids in ascending document order.

    A null text is empty and so has the end id only. Null document ids come first; rows that repeat a
    document id are all written. Other columns are ignored. An empty table gives a manifest without rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = stream = None
        for batch in (part for whole in batches for part in bounded(whole, 1)):
            if writer is None:
                context = TaskContext.get()
                part = context.partitionId()
                name = f"part-{part:06d}-{context.taskAttemptId()}.idp"
                files, folder = file_system(path)
                files.create_dir(f"{folder}/data", recursive=True)
                stream = files.open_output_stream(f"{folder}/data/{name}")
                writer = PlaneWriter(stream, block_ids, kind, level)
                encode = encoder(tokenizer, spaces)
            ids, bounds = with_end(*encode.batch(batch.column(1)), end_id)
            writer.add(batch.column(0).to_pylist(), ids, bounds)
        if writer is not None:
            n_ids, n_docs, n_bytes = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [name], "n_ids": [n_ids], "n_docs": [n_docs], "n_bytes": [n_bytes]}
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row a document: id, position of its first id among all ids, count, CRC-32 and the ids themselves.

    ``ids=False`` leaves the last column out.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    files = manifest.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    schema = READ if ids else READ.rsplit(",", 1)[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(column.to_pylist() for column in batch.columns)):
                files, folder = file_system(path)
                with files.open_input_file(f"{folder}/data/{name}") as stream:
                    rows, held = [], 0
                    for doc_id, at, found in PlaneReader(stream).documents():
                        crc = zlib.crc32(np.ascontiguousarray(found, "<u4"))
                        rows.append((doc_id, base + at, len(found), crc, found if ids else None))
                        held += len(found) if ids else 1
                        if held >= 1_000_000:
                            yield _rows(rows, ids)
                            rows, held = [], 0
                    yield _rows(rows, ids)

    return placed.repartition(max(1, files)).mapInArrow(read, schema)


def _rows(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    columns = {name: pa.array([row[k] for row in rows], pa.int64()) for k, name in enumerate(names)}
    if ids:
        columns["ids"] = pa.array([row[4] for row in rows], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(columns)
