from __future__ import annotations

import hashlib
import re

import pytest

from tickloom.llm import grace_dedup as G


def brute(rows):
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[ \t-\r]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("memory", [0, 200, 96 << 20])
def test_groups_match_brute_force(spark, make_docs, odd_texts, memory):
    rows = list(enumerate(odd_texts)) + [(100 + k, odd_texts[k % 7]) for k in range(60)]
    rows += [(1000 + k, f"single {k}") for k in range(80)] + [(None, "plain words here"), (None, "only null"), (7, "plain words here")]
    found = G.exact_groups(make_docs(rows), memory_bytes=memory).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_equal_hashes_are_told_apart():
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    texts = [b"a", b"b", b"a", b"c", b"b", b"a"]
    records = [G.Record(k, 5, 1, k, k, press.compress(text)) for k, text in enumerate(texts)]
    found = list(G.merge(iter(records), 1 << 20, "/unused"))
    links = dict(item for item in found if isinstance(item, tuple))
    assert links == {0: 0, 1: 1, 2: 0, 3: 3, 4: 1, 5: 0}
    assert {(r.id, r.size) for r in found if isinstance(r, G.Record)} == {(0, 3), (1, 2), (3, 1)}


def test_one_hash_and_no_memory_still_ends(spark):
    import tempfile

    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    records = [G.Record(k, 9, 1, k, k, press.compress(b"text %d" % (k % 12))) for k in range(40)]
    with tempfile.TemporaryDirectory() as folder:
        found = list(G.merge(iter(records), 0, folder))
    assert sorted(r.size for r in found if isinstance(r, G.Record)) == sorted([4] * 4 + [3] * 8)


def test_dropping_keeps_columns(make_docs):
    docs = make_docs([(2, "same  text"), (1, "same text"), (3, "other"), (3, "other"), (4, None), (5, "")])
    left = G.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
    assert G.drop_copies(docs.where("doc_id > 9")).count() == 0
    assert G.exact_groups(docs.where("doc_id > 9")).count() == 0
