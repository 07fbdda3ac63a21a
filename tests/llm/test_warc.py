from __future__ import annotations

import gzip

from tickloom.llm import warc as W
from tickloom.session import scratch_path


def captured(spark, rows, **options):
    pages = spark.createDataFrame([(*row, 1, "x") for row in rows], "page_id LONG, url STRING, html STRING, size INT, sha STRING")
    path = scratch_path(spark, "warc")
    W.write_archives(pages.repartition(3), path, **options)
    return path, W.captures(W.read_records(spark, path)).collect()


def test_round_trip(spark):
    rows = [
        (1, "http://a.example/x y", "<p>é\r\n\r\n</p>"), (2, None, None), (3, "http://b.example/", ""), (None, "u\r\nX: y", "<p>n</p>"),
        (4, "http://c.example/", "copy"), (9, "http://d.example/", "copy"), (5, "e", "copy"), (7, "f", "z" * 300_000), (6, "g", "WARC/1.1\r\n\r\n"),
    ]
    _, found = captured(spark, rows)
    by = {r.metadata.fields["page-id"]: r for r in found}
    assert len(found) == len(rows)
    for page_id, _, html in rows:
        row = by["" if page_id is None else str(page_id)]
        payload = (html or "").encode()
        assert row.response.payload_digest == W.payload_digest(payload)
        assert int(row.metadata.fields["payload-length"]) == len(payload)
        assert row.request.record_id and row.metadata.record_id and row.capture_id == row.response.record_id
        if row.response.type == "response":
            assert bytes(row.response.payload) == payload and row.response.payload_bytes == len(payload)
    kinds = {k: (r.response.type, r.metadata.fields.get("refers-to-page")) for k, r in by.items()}
    assert kinds["9"] == ("response", None) and kinds["4"] == kinds["5"] == ("revisit", "9")
    assert kinds["3"] == ("response", None) and kinds["2"] == ("revisit", "3")
    assert by["4"].response.refers_to == by["9"].response.record_id


def test_small_payloads_are_all_responses(spark):
    _, found = captured(spark, [(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "larger one"), (4, "d", "larger one")], min_bytes=5)
    assert {r.metadata.fields["page-id"]: r.response.type for r in found} == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_repeated_rows_and_hot_payload(spark):
    rows = [(5, "a", "same")] * 3 + [(k, "a", "hot") for k in range(10, 600)]
    _, found = captured(spark, rows)
    kinds = [(r.metadata.fields["page-id"], r.response.type) for r in found]
    assert len(found) == len(rows) and len({r.capture_id for r in found}) == len(rows)
    assert sorted(kind for page, kind in kinds if page == "5") == ["response", "revisit", "revisit"]
    assert [page for page, kind in kinds if kind == "response" and page != "5"] == ["599"]


def test_archives_are_plain_warc(spark):
    path, _ = captured(spark, [(1, "http://a.example/", "<p>hi</p>")])
    row = spark.read.parquet(f"{path}/manifest").first()
    from tickloom.llm.common import file_system

    files, folder = file_system(path)
    with files.open_input_stream(f"{folder}/data/{row.file}", compression=None) as stream:
        raw = gzip.decompress(stream.read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.count(b"\r\nWARC-Concurrent-To: <urn:uuid:") == 2
    assert b"\r\n\r\n<p>hi</p>\r\n\r\nWARC/1.1" in raw


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id LONG, url STRING, html STRING")
    path = scratch_path(spark, "warc")
    W.write_archives(pages, path)
    assert W.captures(W.read_records(spark, path)).count() == 0


def test_request_and_metadata_share_one_reading(spark):
    """The archives are read for the main records and once more for both kinds beside them."""
    path, _ = captured(spark, [(1, "a", "x"), (2, "b", "x")])
    plan = W.captures(W.read_records(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_repeated_and_missing_records(spark):
    rows = [("m1", "response", None), ("m2", "revisit", None), ("r1", "request", "m1"), ("r2", "request", "m1"), ("x1", "metadata", "m1"),
            ("x2", "metadata", "m1"), ("x3", "metadata", "m1"), ("r3", "request", "none"), ("r4", "request", None)]
    full = [(i, kind, "u", "d", to, None, None, None, None, None) for i, kind, to in rows]
    found = W.captures(spark.createDataFrame(full, W.RECORD)).collect()
    got = sorted((r.capture_id, r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in found if r.capture_id == "m1")
    assert got == [("m1", r, x) for r in ("r1", "r2") for x in ("x1", "x2", "x3")]
    (other,) = [r for r in found if r.capture_id == "m2"]
    assert other.request is None and other.metadata is None and len(found) == 7


def test_unasked_payloads_are_not_shuffled(spark):
    path, _ = captured(spark, [(1, "a", "x")])
    asked = W.captures(W.read_records(spark, path)).select("response.type", "metadata.fields")
    lines = asked._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = lines[: next(k for k, line in enumerate(lines) if "Filter" in line)]
    assert any("Join" in line for line in above) and not any("payload#" in line for line in above)
