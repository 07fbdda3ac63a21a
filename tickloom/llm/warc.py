"""WARC archives: written record by record, read back, and assembled into captures.

Each page gives a request, a response or revisit, and a metadata record. The latter two records name the
record they belong to in WARC-Concurrent-To. Payloads of at least ``min_bytes`` that occur several times are
stored once, in the response with the largest page id; other records of that payload are revisits. Archives
are written by Spark tasks, one file each with one gzip member a record; a file counts once the manifest,
written by Spark's commit protocol, lists it. Reading parses the files into records; assembly joins request,
response and metadata through the concurrent-to ids into one nested row a capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, known_join, saved, whole_text

MANIFEST = "part LONG, file STRING, n_records LONG, n_bytes LONG"
RECORD = (
    "record_id STRING, type STRING, target_uri STRING, date STRING, concurrent_to STRING, refers_to STRING, "
    "payload_digest STRING, payload_bytes LONG, payload BINARY, fields MAP<STRING, STRING>"
)
_SPACE_OF_IDS = uuid.UUID("6b3f7c1e-52a4-4c0b-9d6e-0f6a2f1c8b11")
_PAGE_BYTES = 16 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(role: str, page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_OF_IDS, f'{role}:{page_id}:{digest}:{nth}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """A header value without spaces or control characters."""
    raw = url if url is not None else f"urn:page:{page_id}"
    return "".join(c if "\x21" <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in raw)


def _record(kind: str, record_id: str, uri: str, date: str, block: bytes, media: str, **more: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Date: {date}", f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    lines += [f"WARC-{name.replace('_', '-').title()}: {value}" for name, value in more.items() if value is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _capture(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, is_first: bool, nth: int, date: str) -> list[bytes]:
    """The three records of one page."""
    digest, uri = payload_digest(payload), _uri(url, page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    kind = "response" if is_first else "revisit"
    main_id = _record_id("main", page_id, digest, nth)
    about = [f"page-id: {'' if page_id is None else page_id}", f"payload-length: {len(payload)}"]
    profile = first_record = None
    if not is_first:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        first_record = _record_id("main", first_id, digest, 0)
        about.append(f"refers-to-page: {'' if first_id is None else first_id}")
    host = uri.split("/")[2] if uri.count("/") >= 2 else uri
    ask = f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    return [
        _record(
            kind, main_id, uri, date, head.encode() + (payload if is_first else b""), "application/http;msgtype=response",
            payload_digest=f"sha1:{digest}", profile=profile, refers_to=first_record,
        ),
        _record("request", _record_id("request", page_id, digest, nth), uri, date, ask, "application/http;msgtype=request", concurrent_to=main_id),
        _record("metadata", _record_id("metadata", page_id, digest, nth), uri, date, "".join(f"{x}\r\n" for x in about).encode(), "application/warc-fields", concurrent_to=main_id),
    ]


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6
) -> None:
    """Write a capture for every row of ``pages`` (``page_id, url, html``) under ``path``.

    A null html is an empty payload, a null url becomes ``urn:page:<id>``. Null page ids rank below all
    others. Rows that repeat page id and payload are captures of their own: the first one can be the
    response, the others revisit it. Other columns are ignored; an empty table gives no archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole_text("html").alias("html"))
    digested = saved(
        rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size")), "payload-digests"
    )
    groups = digested.where(F.col("size") >= min_bytes).groupBy("sha").agg(
        F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    several = saved(groups.where("copies > 1"), "payload-groups")
    decided = known_join(digested.select("page_id", "sha").distinct(), several, "sha", "copies", digested.count())
    # One shuffle of the payloads: rows that repeat page id and payload must meet, in any join that Spark picks.
    key = F.concat_ws(":", F.col("page_id").cast("string"), F.col("sha"))
    decided = decided.select(key.alias("key"), "first_id", F.lit(True).alias("grouped"))
    keyed = rows.withColumn("sha", F.sha1("html")).withColumn("key", key).repartition("key")
    placed = keyed.join(decided, "key", "left").select("page_id", "url", "html", "sha", "first_id", "grouped")
    placed = placed.sortWithinPartitions("page_id", "sha")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, count, size, before, nth = None, 0, 0, None, 0
        for batch in batches:
            for page_id, url, html, sha, first_id, grouped in zip(*(column.to_pylist() for column in batch.columns)):
                if stream is None:
                    context = TaskContext.get()
                    part = context.partitionId()
                    name = f"part-{part:06d}-{context.taskAttemptId()}.warc.gz"
                    files, folder = file_system(path)
                    files.create_dir(f"{folder}/data", recursive=True)
                    stream = files.open_output_stream(f"{folder}/data/{name}", compression=None)
                nth = nth + 1 if before == (page_id, sha) else 0
                before = (page_id, sha)
                is_first = not grouped or (page_id == first_id and nth == 0)
                for record in _capture(page_id, url, html.encode(), first_id, is_first, nth, date):
                    member = gzip.compress(record, level, mtime=0)
                    stream.write(member)
                    count, size = count + 1, size + len(member)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_records": [count], "n_bytes": [size]})

    placed.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The records of a file with one gzip member each."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("archive ends inside a record")
                return
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple:
    """A record's columns as in :data:`RECORD`."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    block = block[: int(named["content-length"])]
    kind, payload, fields, digest, size = named["warc-type"], None, None, None, None
    if kind in ("response", "revisit"):
        digest = named.get("warc-payload-digest", "").partition(":")[2] or None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = payload_digest(payload), len(payload)
    elif kind == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line)
    at = [named.get(f"warc-{name}") for name in ("record-id", "type", "target-uri", "date", "concurrent-to", "refers-to")]
    return *at, digest, size, payload, fields


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, a row each as in :data:`RECORD`."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    names = [part.split()[0] for part in RECORD.split(", ") if not part.startswith("STRING")]
    types = dict.fromkeys(names, pa.string()) | {
        "payload_bytes": pa.int64(), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string()),
    }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = {}
            for k, name in enumerate(names):
                values = [row[k] for row in rows]
                if name == "fields":
                    values = [None if value is None else list(value.items()) for value in values]
                columns[name] = pa.array(values, types[name])
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, folder = file_system(path)
                rows, held = [], 0
                with files.open_input_stream(f"{folder}/data/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        rows.append(parse_record(raw))
                        held += len(raw) + 200
                        if held > _PAGE_BYTES:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(read, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit, and the request and metadata concurrent to it.

    A capture without request or metadata has null there; records that name no known capture are left out.
    """
    main = records.where(F.col("type").isin("response", "revisit"))
    main = main.select(
        F.col("record_id").alias("capture_id"),
        F.struct("record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"),
    )

    # One reading of the archives for both kinds, whose rows are small; every request meets every metadata record.
    def listed(kind: str) -> Column:
        return F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", "date", "fields"))).alias(kind)

    beside = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    beside = beside.groupBy(F.col("concurrent_to").alias("capture_id")).agg(listed("request"), listed("metadata"))
    for kind in ("request", "metadata"):
        beside = beside.withColumn(kind, F.explode_outer(kind))
    # Parsed records look small to the planner, which only sees the manifest; they must not be broadcast. Nothing but the
    # join stands above the main records, so that payloads nobody asks for are not shuffled.
    return main.join(beside.hint("merge"), "capture_id", "left")
