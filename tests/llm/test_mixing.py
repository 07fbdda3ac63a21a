from __future__ import annotations

import random
import re

import pytest

from tickloom.llm import mixing as M


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for k in range(400):
        source = rng.choice([None, "", "a", "b", "b", "b", "b", "é", "z", "tiny"]) if k else "tiny"
        size = rng.choice([0, 1, 5, 70, 200]) if source != "tiny" else 3
        out.append((k, " ".join(["w"] * size), "en", source))
    return out + [(None, "no id here", "en", "b"), (3, "x y", "en", "a"), (3, "x y", "en", "a"), (5, None, "en", "a"), (5, None, "en", "a")]


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in sizes)
    weight = {name: weights[k % 3] for k, name in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, open_ = share * sum(sizes.values()), set(names)
    while open_ and rest > 1e-9:
        unit = rest / sum(weight[n] for n in open_)
        for name in open_:
            target[name] += unit * weight[name]
        rest = sum(max(0.0, target[n] - most * sizes[n]) for n in names)
        for name in names:
            if target[name] >= most * sizes[name]:
                target[name] = most * sizes[name]
                open_.discard(name)
    return target


def test_mix_matches_brute_force(make_docs, rows):
    docs = make_docs(rows)
    mix = M.mix(docs, block_words=8, shard_slots=50, bucket_docs=30)
    taken = mix.taken.collect()
    words = [len(re.findall("[^ \t-\r]+", text or "")) for _, text, *_ in rows]
    assert sorted(r.size for r in taken) == sorted(words) and len(taken) == len(rows)
    sizes: dict = {}
    for (_, _, _, source), n in zip(rows, words):
        sizes[source] = sizes.get(source, 0) + n
    target = brute_targets(sizes)
    got: dict = {}
    for r in taken:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        got[r.source] = got.get(r.source, 0) + r.taken
    for source, n in got.items():
        assert abs(n - target[source]) <= 3 * 8
    # What is taken is what the slots say, block by block.
    times: dict = {}
    for r in mix.slots.collect():
        times[r.source_no, r.block] = times.get((r.source_no, r.block), 0) + 1
    assert max(times.values()) <= 2
    again: dict = {}
    length: dict = {}
    for r in mix.pieces.collect():
        again[r.doc_id, r.tie] = again.get((r.doc_id, r.tie), 0) + r.n_words * times.get((r.source_no, r.block), 0)
        length[r.source_no, r.block] = length.get((r.source_no, r.block), 0) + r.n_words
    by_doc: dict = {}
    for r in taken:
        by_doc[r.doc_id, r.tie] = by_doc.get((r.doc_id, r.tie), 0) + r.taken
    assert {k: n for k, n in by_doc.items() if n} == {k: n for k, n in again.items() if n}
    for r in mix.sources.collect():
        own = sorted((b, n) for (s, b), n in length.items() if s == r.source_no)
        assert [b for b, _ in own] == list(range(r.blocks)) and all(n == 8 for _, n in own[:-1])
        assert sum(n for (s, _), n in times.items() if s == r.source_no) == r.slots


def test_reruns_agree(make_docs, rows):
    first = M.mix(make_docs(rows), block_words=8).taken
    second = M.mix(make_docs(list(reversed(rows))).repartition(7), block_words=8).taken
    assert sorted(first.collect(), key=str) == sorted(second.collect(), key=str)


def test_shards_draw_about_their_share(make_docs, rows):
    mix = M.mix(make_docs(rows), block_words=1, shard_slots=2000)
    slots = mix.slots.toPandas()
    share = {r.source_no: r.slots for r in mix.sources.collect()}
    total = sum(share.values())
    for _, shard in slots.groupby("shard"):
        for no, n in shard.source_no.value_counts().items():
            p = share[no] / total
            assert abs(n - p * len(shard)) <= 6 * (p * len(shard)) ** 0.5 + 5


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        at = spark.range(n).select(M._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit("k")).alias("x"))
        found = [r.x for r in at.collect()]
        assert sorted(found) == list(range(n)) and (n < 100 or found != sorted(found))


def test_documents_and_empty_tables(make_docs, rows):
    docs = make_docs(rows)
    mixed = M.mixed_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    counts = mixed.groupBy("doc_id", "text").count().collect()
    assert counts and max(r["count"] for r in counts if r.doc_id != 3) <= 2
    empty = docs.where("doc_id < 0")
    assert M.mix(empty).taken.count() == 0 and M.mixed_documents(empty).count() == 0
    nothing = M.mix(docs.where("text is null")).taken.collect()
    assert [(r.size, r.taken, r.target) for r in nothing] == [(0, 0, 0.0)] * 2
