"""Exact duplicates by Grace hashing.

A merge step reads records in any order and groups those of equal content in an open-addressing table that
compares whole contents. Once the table holds ``memory_bytes`` of contents, records of contents not yet in it
go to one of sixteen spill files by bits of their hash, and each file is merged in the same way after the
stream has ended. Every pass takes at least one content into its table, so this ends even if all hashes are
equal; copies of one content never fill the table.

There are three steps. The first merges each input partition as it is read, so that a text that makes up a
third of the table leaves each partition once. The second deals what is left by the hash of the content and
a number derived from the partition; the third by the hash alone. With P partitions no task of the second or
third step gets more than about sqrt(P) records of one content. Each step writes its links (record to
representative) and its representatives to the shared folder; three joins of narrow rows lead every document
to its group.

Spill files lie in the shared folder too, under the name of the task attempt, and go when they have been read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import scratch_path

from .common import SPACE, file_system, saved, whole_text

FAN_OUT = 16
MERGED = (
    "id LONG, doc_id LONG, sha STRING, to LONG, key LONG, size LONG, best_doc LONG, best_id LONG, content BINARY"
)
_FIXED = "<qQqqQq"
_NO_DOC = (1 << 63) - 1


@dataclass
class Record:
    """Some equal rows: where they came from, how many they are, the first of them, and their content."""

    id: int
    key: int
    size: int
    best_doc: int
    best_id: int
    content: bytes  # compressed

    def packed(self) -> bytes:
        return struct.pack(_FIXED, self.id, self.key, self.size, self.best_doc, len(self.content), self.best_id) + self.content


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by the whole content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[Record] = []
        self.held = 0
        self._open = zstandard.ZstdDecompressor()

    def _probe(self, record: Record) -> int:
        mask = len(self.slots) - 1
        at = record.key & mask
        while self.slots[at] >= 0:
            other = self.entries[self.slots[at]]
            if other.key == record.key and self._same(other.content, record.content):
                return at
            at = (at + 1) & mask
        return at

    def _same(self, a: bytes, b: bytes) -> bool:
        return a == b or self._open.decompress(a) == self._open.decompress(b)

    def find(self, record: Record) -> Record | None:
        at = self.slots[self._probe(record)]
        return None if at < 0 else self.entries[at]

    def insert(self, record: Record) -> None:
        if 2 * len(self.entries) >= len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for k, entry in enumerate(self.entries):
                mask, at = len(self.slots) - 1, entry.key & (len(self.slots) - 1)
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k
        self.slots[self._probe(record)] = len(self.entries)
        self.entries.append(record)
        self.held += len(record.content)


class Spill:
    """Spill files of one pass, in the shared folder."""

    def __init__(self, folder: str, level: int) -> None:
        self.files, self.folder = file_system(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.level, self.streams = level, {}

    def add(self, record: Record) -> None:
        bucket = (record.key >> (4 * (self.level % 16))) % FAN_OUT
        if bucket not in self.streams:
            self.streams[bucket] = self.files.open_output_stream(f"{self.folder}/{bucket}")
        self.streams[bucket].write(record.packed())

    def buckets(self) -> Iterator[tuple[int, Iterator[Record]]]:
        for stream in self.streams.values():
            stream.close()
        for bucket in sorted(self.streams):
            yield bucket, self._read(bucket)
        self.files.delete_dir(self.folder)

    def _read(self, bucket: int) -> Iterator[Record]:
        with self.files.open_input_stream(f"{self.folder}/{bucket}") as stream:
            while head := stream.read(struct.calcsize(_FIXED)):
                id_, key, size, best_doc, length, best_id = struct.unpack(_FIXED, head)
                yield Record(id_, key, size, best_doc, best_id, stream.read(length))


def merge(records: Iterator[Record], memory_bytes: int, folder: str, level: int = 0) -> Iterator[tuple[int, int] | Record]:
    """Links (record, representative) as they are found, and after them the merged representatives."""
    table, spill = ContentTable(), None
    for record in records:
        known = table.find(record)
        if known is not None:
            yield record.id, known.id
            known.size += record.size
            known.best_doc, known.best_id = min((known.best_doc, known.best_id), (record.best_doc, record.best_id))
        elif not table.entries or table.held + len(record.content) <= memory_bytes:
            yield record.id, record.id
            table.insert(record)
        else:
            spill = spill or Spill(f"{folder}/{level}", level)
            spill.add(record)
    yield from table.entries
    if spill:
        del table
        for bucket, rest in spill.buckets():
            yield from merge(rest, memory_bytes, f"{folder}/{level}-{bucket}", level + 1)


def _emit(found: Iterator[tuple[int, int] | Record], own: dict[int, tuple], key_sign: int = 1 << 63) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`MERGED`: links have ``to``, representatives have ``content``."""
    names = [part.split()[0] for part in MERGED.split(", ")]
    types = dict.fromkeys(names, pa.int64()) | {"sha": pa.string(), "content": pa.binary()}
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {name: pa.array([row[k] for row in rows], types[name]) for k, name in enumerate(names)}
        )

    for item in found:
        if isinstance(item, Record):
            key = item.key - (1 << 64) if item.key >= key_sign else item.key
            rows.append((item.id, None, None, None, key, item.size, item.best_doc, item.best_id, item.content))
            held += len(item.content)
        else:
            doc_id, sha = own.pop(item[0], (None, None))
            rows.append((item[0], doc_id, sha, item[1], None, None, None, None, None))
        held += 100
        if held > 8 << 20:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 96 << 20
) -> DataFrame:
    """For each row its group of equal texts: the row that stays, the group's size, the text's SHA-256.

    Texts are equal when they are identical after each run of ASCII white space has become one space. A null
    text is empty. The row with the smallest document id stays; null ids come last, and of rows that repeat
    the id too just one is kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch_path(spark, "grace")
    content = F.regexp_replace(whole_text(text_col), SPACE, " ")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), content.alias("text"))
    rows = rows.select("doc_id", "text", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("key"))

    def read_rows(batches: Iterator[pa.RecordBatch], own: dict[int, tuple]) -> Iterator[Record]:
        press = zstandard.ZstdCompressor(level=1)
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text, sha, key in zip(*(column.to_pylist() for column in batch.columns)):
                own[at] = (doc_id, sha)
                best = _NO_DOC if doc_id is None else doc_id
                yield Record(at, key % (1 << 64), 1, best, at, press.compress(text.encode()))
                at += 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple] = {}
        folder = f"{scratch}/{TaskContext.get().taskAttemptId()}"
        return _emit(merge(read_rows(batches, own), memory_bytes, folder), own)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (
            Record(id_, key % (1 << 64), size, best_doc, best_id, text)
            for batch in batches
            for id_, key, size, best_doc, best_id, text in zip(*(column.to_pylist() for column in batch.columns))
        )
        folder = f"{scratch}/{TaskContext.get().taskAttemptId()}"
        return _emit(merge(records, memory_bytes, folder), {})

    carried = ("id", "key", "size", "best_doc", "best_id", "content")
    first = saved(rows.mapInArrow(local, MERGED), "grace-1")
    parts = (first.agg(F.max(F.shiftright("id", 33))).first()[0] or 0) + 1
    spread = max(1, round(parts**0.5))
    left = first.where("content IS NOT NULL").select(*carried)
    dealt = left.repartition("key", F.shiftright("id", 33) % spread)
    second = saved(dealt.mapInArrow(again, MERGED), "grace-2")
    left = second.where("content IS NOT NULL").select(*carried)
    third = saved(left.repartition("key").mapInArrow(again, MERGED).drop("content"), "grace-3")

    def links(step: DataFrame, source: str, target: str) -> DataFrame:
        return step.where("to IS NOT NULL").select(F.col("id").alias(source), F.col("to").alias(target))

    groups = third.where("size IS NOT NULL").select(F.col("id").alias("top"), "size", "best_doc", "best_id")
    groups = links(third, "middle", "top").join(groups, "top")
    groups = links(second, "rep", "middle").join(groups, "middle").select("rep", "size", "best_doc", "best_id")
    members = first.where("to IS NOT NULL").select(F.col("id").alias("row"), "doc_id", "sha", F.col("to").alias("rep"))
    return members.join(groups, "rep").select(
        "doc_id",
        F.when(F.col("best_doc") != _NO_DOC, F.col("best_doc")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` does not keep, with all their columns."""

    def key(doc_id: str, sha: str) -> Column:
        return F.concat_ws(":", F.col(doc_id).cast("string"), F.col(sha)).alias("_copy_key")

    kept = exact_groups(docs, id_col, text_col).where("kept").select(key("doc_id", "text_sha256"))
    sha = F.sha2(F.regexp_replace(whole_text(text_col), SPACE, " "), 256)
    keyed = docs.withColumn("_copy_sha", sha)
    keyed = keyed.withColumn("_copy_key", key(id_col, "_copy_sha")).drop("_copy_sha")
    return keyed.join(kept, "_copy_key", "left_semi").dropDuplicates(["_copy_key"]).drop("_copy_key")
