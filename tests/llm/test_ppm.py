from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from tickloom.llm import ppm as P


def brute(rows):
    """The definitions, one document and one byte at a time."""
    train = [(text or "").encode() for i, text in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for text in train for w in text.lower().split())
    n, v = sum(words.values()) + len(train), len(words) + (len(train) > 0)
    trie: dict[tuple, Counter] = {}
    for text in train:
        row = [P.START] * P.ORDER + list(text) + [P.END]
        for k in range(P.ORDER, len(row)):
            for length in range(P.ORDER + 1):
                trie.setdefault(tuple(row[k - length : k]), Counter())[row[k]] += 1

    def log_p(context, symbol):
        total, excluded = 0.0, set()
        for length in range(P.ORDER, -1, -1):
            children = trie.get(tuple(context[len(context) - length :]), {})
            left = {s: c for s, c in children.items() if s not in excluded}
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return total + math.log10(left[symbol] / whole)
            if left:
                total += math.log10(len(left) / whole)
            excluded |= children.keys()
        return total - math.log10(P.SYMBOLS - len(excluded))

    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        tokens = raw.lower().split()
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        base += math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        row = [P.START] * P.ORDER + list(raw) + [P.END]
        score = sum(log_p(row[k - P.ORDER : k], row[k]) for k in range(P.ORDER, len(row)))
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0
        known = sum(words[w] > 0 for w in tokens) + (len(train) > 0)
        out.append((doc_id, held, len(tokens) + 1, known, n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, group", [(16 << 20, 200_000), (300, 50)])
def test_scores_match_brute_force(make_docs, odd_texts, chunk, group):
    rng = random.Random(2)
    rows = [(k, text) for k, text in enumerate(odd_texts) if len(text or "") < 10_000]
    rows += [(100 + k, " ".join(rng.choice(["The", "the", "of", "ofthe", "éa", "Z"]) for _ in range(rng.randrange(30)))) for k in range(80)]
    rows += [(None, "the end"), (101, rows[-1][1]), (101, rows[-1][1])]
    found = P.score_documents(make_docs(rows), chunk_bytes=chunk, group_runs=group).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found]
    for a, b in zip(sorted(got, key=str), brute(rows), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)


def test_long_texts_and_no_training(make_docs, odd_texts):
    long_text = max((t or "" for t in odd_texts), key=len)
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 10 == 0)
    only = P.score_documents(make_docs([(held, "ab")])).collect()[0]
    assert only.n_known == 0 and only.train_tokens == 0 and only.score == pytest.approx(-3 * math.log10(257))
    found = {r.doc_id: r for r in P.score_documents(make_docs([(1, long_text), (held, long_text[:5000])])).collect()}
    assert found[held].held_out and found[1].n_tokens == len(long_text.split()) + 1
    assert found[held].score > -5000 * math.log10(257)
    assert P.score_documents(make_docs([(1, "x")]).where("doc_id > 1")).count() == 0


def test_the_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = P.score_documents(docs).where("held_out").selectExpr("sum(score) AS score", "sum(base_score) AS base").first()
    assert held.score > held.base * 1.2
