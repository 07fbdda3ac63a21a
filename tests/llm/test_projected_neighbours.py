from __future__ import annotations

import numpy as np
import pytest

from tickloom.llm import projected_neighbours as P
from tickloom.llm import queries as Q

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, vector STRING, node INT, cell INT, part INT, query INT, ids INT, score INT"


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        full = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "v", 2, 3, 4, 5, 6, 7) for i, v in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


def good(v, length):
    return v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(queries, rows, k=5):
    lengths = [len(v) for _, v in rows if v is not None]
    length = max(set(lengths), key=lengths.count)
    base = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and good(v, length)})
    out = {}
    for i, v in queries:
        if i is None or not good(v, length):
            continue
        a = np.float32(v).astype(float)
        scored = []
        for j, w in base:
            if j != i:
                b = np.array(w)
                scored.append((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 12), j))
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def result(df):
    found = {}
    for r in sorted(df.collect()):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r.rank == len(found[r.query_id])
    return found


def test_whole_search_is_exact_on_odd_rows(make):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6)) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300 + i, rows[7][1]) for i in range(3)]
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1, None, 2, 3, 4, 5]), (404, [float("nan")] * 6), (405, [1, 2, 3, 4, 5, float("inf")])]
    rows += [(406, [1.0, 2.0]), (None, rows[3][1]), rows[9], rows[9], (407, -rows[0][1]), (408, [1e-38] * 6), (409, [3e38, -3e38] * 3)]
    base = make(rows)
    want = brute(rows, rows)
    got = result(P.neighbours(base, base, confidence=1 - 1e-9, cell_rows=40, queries_per_task=50))
    assert got == want
    assert got[200] == [(0, 1.0)] + [(i, 1.0) for i in range(201, 205)]


def test_recall_in_clusters_and_in_noise(make):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32)) * 3
    clustered = [(i, centres[i % 20] + rng.normal(size=32)) for i in range(3000)]
    noise = [(i, rng.normal(size=32)) for i in range(3000)]
    for rows in clustered, noise:
        asked = rows[::50]
        want = brute(asked, rows)
        got = result(P.neighbours(make(asked), make(rows), cell_rows=300))
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * 5 * len(want)
        exact = {q: dict(w) for q, w in brute(asked, rows, k=3000).items()}
        assert all(exact[q][i] == score for q in got for i, score in got[q])


def test_few_or_no_candidates(make):
    three = make([(50, [1, 0]), (1, [1, 1]), (2, [-1, 0]), (3, None)])
    assert result(P.neighbours(three.where("vec_id = 50"), three)) == {50: [(1, round(0.5**0.5, 12)), (2, -1.0)]}
    one = make([(50, [1, 0])])
    assert P.neighbours(one, one).collect() == []
    for nothing in make([(1, None), (2, [0, 0])]), one.where("false"):
        assert P.neighbours(one, nothing).collect() == [] and P.neighbours(nothing, one).collect() == []


def test_chi_square_quantile():
    # two degrees: the exponential law; one: the square of a normal
    assert P.chi_square_quantile(0.95, 2) == pytest.approx(-2 * np.log(0.05), rel=1e-9)
    assert P.chi_square_quantile(0.95, 1) == pytest.approx(1.959963984540054**2, rel=1e-9)
    draws = np.random.default_rng(1).chisquare(8, 200_000)
    assert np.mean(draws < P.chi_square_quantile(0.9, 8)) == pytest.approx(0.9, abs=0.005)


def test_search_stops_early():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 5
    vectors = P.unit(centres[np.arange(4000) % 40] + rng.normal(size=(4000, 16)) * 0.2)
    onto = P.directions(16, 8, 1)
    tree = P.Tree(vectors @ onto)
    assert sorted(np.concatenate(tree.leaves)) == list(range(4000)) and max(map(len, tree.leaves)) <= P.LEAF_ROWS
    seen = []

    class Counted:
        leaves, low, high = tree.leaves, tree.low, tree.high

    class Leaves(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)

    Counted.leaves = Leaves(tree.leaves)
    asked = vectors[:1]
    best, rows = P.search(Counted, vectors, asked, asked @ onto, np.full(1, np.inf), 6, P.chi_square_quantile(0.95, 8))
    exact = np.sort(vectors @ asked[0])[-6:]
    assert np.allclose(np.sort(best[0]), exact) and len(seen) < len(tree.leaves) / 3


def test_registered_query_recall(spark):
    folder = "/root/testdata/sf0.01"
    got = result(Q.op13_projected_neighbours(spark, folder))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute([(i, v) for i, v in rows if i % 50 == 0], rows)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
