from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tickloom.llm import collocations as L
from tickloom.llm import queries as Q


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_counts(rows, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered(text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    return f, n


def brute(rows, threshold=30, top=2000):
    f, n = brute_counts(rows)
    kept = []
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= threshold}
    for (lang, words), a in candidates.items():
        if any(
            g == lang and len(w) > len(words) and 100 * b >= 80 * a and any(w[i : i + len(words)] == words for i in range(len(w)))
            for (g, w), b in candidates.items()
        ):
            continue
        cuts = [(f[lang, words[:k]], f[lang, words[k:]], k) for k in range(1, len(words))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for l, r, k in cuts)
        kept.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out, ranks = [], Counter()
    for lang, score, a, phrase, l, r in sorted(kept):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def corpus(odd_texts, seed=2):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "Straße", "ünder", "a|b", "x"]
    rows = [(" ".join(rng.choices(words, range(9, 0, -1), k=rng.randint(0, 40))) + rng.choice([".", "", " \t", "\n\n"]), rng.choice(["en", "de"])) for _ in range(120)]
    rows += [("New York City. new york city, NEW YORK CITY;once more", None)] * 9
    return rows + [(text, "en") for text in odd_texts] + [(None, None)]


@pytest.mark.parametrize("threshold, top", [(3, 2000), (5, 7), (30, 50)])
def test_matches_brute_force(make_docs, odd_texts, threshold, top):
    rows = corpus(odd_texts)
    docs = make_docs([(i, text, lang) for i, (text, lang) in enumerate(rows)])
    got = sorted(tuple(r) for r in L.collocations(docs, threshold, top=top).collect())
    assert got == sorted(brute(rows, threshold, top)) != []


def test_small_slices_and_a_full_bit_map_change_nothing(make_docs, odd_texts, monkeypatch):
    monkeypatch.setattr(L.Survivors.__init__, "__defaults__", (24,))  # two bytes a partition
    rows = corpus(odd_texts, 3)
    docs = make_docs([(i, text, lang) for i, (text, lang) in enumerate(rows)]).repartition(17)
    got = sorted(tuple(r) for r in L.collocations(docs, 4).collect())
    assert got == sorted(brute(rows, 4))


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(1)
    for threshold in 5, 30:
        stream = np.concatenate([rng.zipf(1.3, 20_000) % 5000, np.repeat(rng.integers(5000, 1 << 32, 40), threshold)]).astype(np.uint32)
        rng.shuffle(stream)
        true = Counter(stream.tolist())
        capacity = len(stream) // threshold
        for capacity in capacity, capacity // 20:
            parts = [np.unique(part, return_counts=True) for part in np.array_split(stream, 60)]
            keys, counts, lost = L.merge_summaries([(k, c.astype(np.int64)) for k, c in parts], capacity)
            assert len(keys) <= capacity and lost <= len(stream) / (capacity + 1)
            held = dict(zip(keys.tolist(), counts.tolist()))
            assert all(true[k] - lost <= c <= true[k] for k, c in held.items())
            assert all(k in held for k, c in true.items() if c > lost)


def test_words_and_hashes_of_a_slice():
    import pyarrow as pa

    words = L.Words.of(pa.array(["Ab c.d", "", "  ", "é Ab,\tc\x0bd e"]), pa.array(["en", "de", "en", "de"]))
    named = [words.names[i].as_py() for i in words.number]
    assert named == ["ab", "c", "d", "é", "ab", "c", "d", "e"]
    assert [words.langs[i] for i in words.lang] == ["en"] * 3 + ["de"] * 5
    assert words.together(2).tolist() == [True, False, False, True, False, False, True]
    pairs = words.gram_hashes(2)
    assert len(pairs) == 7 and words.gram_hashes(9).size == 0 and pairs[0] != pairs[4]


def test_nothing_to_count(make_docs):
    assert L.collocations(make_docs([]).where("false")).collect() == []
    assert L.collocations(make_docs([(1, None), (2, ""), (3, "one two")])).collect() == []


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    theirs = con.execute(Q.oracle_sql()["op12_collocations"])
    names = [c[0] for c in theirs.description]
    ours = Q.op12_collocations(spark, folder).select(*names).collect()
    assert sorted(map(tuple, ours)) == sorted(theirs.fetchall()) != []
