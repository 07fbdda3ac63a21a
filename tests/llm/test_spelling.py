from __future__ import annotations

import random
import re
import zlib

import duckdb
import pytest

from tickloom.llm import queries as Q
from tickloom.llm import spelling as S


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute(counts, ratio=10):
    out = {}
    for word, n in counts.items():
        others = [other for other in counts if near(word, other)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        out[word] = [best if best is not None and counts[best] >= ratio * n else None, n, len(others)]
    rows = {}
    for word, (form, n, n_near) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        rows[word] = (form, root, n, n_near, counts[form] if form else None)
    return rows


def brute_counts(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_near_words_match_brute_force(spark):
    rng = random.Random(3)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(4, 12)))
        counts[word] = rng.choice([2, 30, 400, 5000, 5000])
        for _ in range(rng.randint(0, 6)):
            i, kind = rng.randrange(len(word)), rng.randrange(3)
            other = word[:i] + ("" if kind == 0 else rng.choice("abcé")) + word[i + (kind != 1) :]
            counts.setdefault(other, rng.choice([2, 3, 40, 400]))
    # repeats of one gram, edits at either end, chains of forms, accents beside plain letters
    counts |= {"aaaaaaa": 9, "aaaaaaaa": 90, "aaaaaaaaa": 900, "aaaaaab": 9, "baaaaaa": 9, "éaaaaaa": 90, "zaaaaaaa": 2, "abc": 7, "ab": 5, "": 4}
    want = {w: v for w, v in brute({w: n for w, n in counts.items() if len(w) >= 4}).items()}
    want |= {w: (None, w, counts[w], 0, None) for w in counts if len(w) < 4}
    table = spark.createDataFrame([(w, n, 1, "k") for w, n in counts.items()], "word STRING, n LONG, key INT, pivot STRING")
    got = found(S.variants(table))
    assert got == want
    assert got["aaaaaaa"][:2] == ("aaaaaaaa", "aaaaaaaaa")


def test_documents_match_brute_force(make_docs, odd_texts):
    rng = random.Random(8)
    words = ["spelling", "variants", "Grouping", "éclairés", "document", "naïveté", "short", "straße", "x÷multiply×y"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(None, "spelling Spelling sPELLING"), (None, None)] + rows[:3]
    rows += [(100 + i, text) for i, text in enumerate(odd_texts)]
    docs = make_docs(rows)
    counts = S.counted(S.with_slips(S.runs(docs)))
    assert {r.word: r.n for r in counts.collect()} == brute_counts(rows)
    assert found(S.variants(counts)) == brute(brute_counts(rows))
    assert any(form for form, *_ in found(S.variants(counts)).values())


def test_pivots_are_disjoint_and_lightest():
    assert S.pivots([0, 1, 2], [1, 1, 9]) == [0, 2]
    assert S.pivots([0, 1, 3], [5, 1, 2]) == [1, 3]
    assert S.pivots([2, 4, 7, 8], [4, 1, 3, 3]) == [4, 7] and S.pivots([0, 1], [1, 1]) == []
    rng = random.Random(1)
    for _ in range(200):
        places = sorted(rng.sample(range(12), 5))
        weights = [rng.randint(1, 9) for _ in places]
        pairs = [(v + w, a, b) for a, v in zip(places, weights) for b, w in zip(places, weights) if b >= a + 2]
        chosen = S.pivots(places, weights)
        assert sum(weights[places.index(p)] for p in chosen) == min(pairs)[0] and chosen[1] >= chosen[0] + 2


def test_empty_table_and_ratio(spark, make_docs):
    assert S.variants(S.counted(S.runs(make_docs([]).where("false")))).collect() == []
    assert S.variants(S.counted(S.with_slips(S.runs(make_docs([(1, None), (2, ""), (3, "one two")]))))).collect() == []
    with pytest.raises(ValueError):
        S.variants(spark.createDataFrame([("a", 1)], "word STRING, n LONG"), ratio=1)


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    ours = Q.op11_pivotal_spelling(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    theirs = con.execute(Q.oracle_sql()["op11_pivotal_spelling"])
    names = [c[0] for c in theirs.description]
    assert sorted(tuple(r) for r in ours.select(*names).collect()) == sorted(theirs.fetchall()) != []
