from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import order_minhash as O
from tickloom.llm.components import components


def plain_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.integers(0, 9))
def test_banded_alignment_is_exact(a, b, most):
    exact = plain_distance(a, b)
    assert O.edit_distance(a, b, most) == (exact if exact <= most else None)


def test_runs_are_labelled_by_occurrence():
    words = np.array([1, 2, 1, 2, 1, 2, 3], np.uint64)
    runs = O.labelled_runs(words, 2)
    assert len(runs) == 6 and len(set(runs.tolist())) == 6
    same = O.labelled_runs(words[:4], 2)
    assert same.tolist() == runs[:3].tolist()
    assert len(O.labelled_runs(words[:0], 2)) == 0 and len(O.labelled_runs(words[:3], 5)) == 1


def test_sketches_keep_the_order_of_the_text():
    seeds = np.arange(1, 40, dtype=np.uint64)
    runs = np.random.default_rng(2).integers(0, 2**63, 6, dtype=np.uint64)
    moved = runs[::-1].copy()
    assert not (O.order_sketches(runs, 6, seeds) == O.order_sketches(moved, 6, seeds)).any()
    assert (O.order_sketches(runs, 1, seeds) == O.order_sketches(moved, 1, seeds)).all()


def edited(rng, words, share):
    out = []
    for word in words:
        if rng.random() < share:
            kind = rng.randrange(3)
            out += [] if kind == 0 else [f"new{rng.randrange(10**6)}"] if kind == 1 else [word, f"new{rng.randrange(10**6)}"]
        else:
            out.append(word)
    return out


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies, a passage that many documents share, exact copies, short and odd texts."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows: list[tuple[int | None, str | None]] = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(40, 300))]
        for _ in range(rng.randrange(1, 6)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0.0, 0.02, 0.05])))))
    for _ in range(60):
        rows.append((len(rows), " ".join([word() for _ in range(40)] + passage + [word() for _ in range(50)])))
    hot = [word() for _ in range(120)]
    rows += [(1000 + k, " ".join(edited(rng, hot, 0.03))) for k in range(60)]
    rows += [(2000 + k, "The Same  text\nhere, again and again.") for k in range(250)]
    rows += [(None, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "One"), (None, "one"), (3005, "x " * 5000)]
    rows += [rows[0], (None, rows[0][1])]
    return rows


def brute_classes(rows):
    texts = [" ".join((text or "").lower().split()) for _, text in rows]
    unique = sorted(set(texts))
    split = [text.split(" ") for text in unique]
    parent = list(range(len(unique)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(split):
        for j in range(i):
            b, longer = split[j], max(len(a), len(split[j]))
            if unique[i] and unique[j] and len(set(a) ^ set(b)) <= 0.8 * longer and abs(len(a) - len(b)) <= 0.2 * longer:
                if plain_distance(a, b) <= 0.2 * longer + 1e-9:
                    parent[find(i)] = find(j)
    label = {text: find(k) for k, text in enumerate(unique)}
    groups: dict[int, list] = {}
    for (doc_id, _), text in zip(rows, texts):
        groups.setdefault(label[text], []).append((doc_id, text))
    return groups


def test_classes_match_brute_force(make_docs, corpus):
    found = O.near_duplicates(make_docs(corpus)).collect()
    want = []
    for members in brute_classes(corpus).values():
        known = [i for i, _ in members if i is not None]
        shape = (min(known) if known else None, len(members), len({text for _, text in members}))
        want += [(doc_id, *shape) for doc_id, _ in members]
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.class_texts) for r in found), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in found) == len(brute_classes(corpus))
    assert all(r.doc_id == r.class_id for r in found if r.kept)


def test_a_pair_in_a_crowded_bucket_is_found(make_docs):
    """Hundreds of texts of one form, over a fifth of whose words differ, and two pairs among them that are close."""
    rng = random.Random(11)
    form = [f"f{k}" for k in range(60)]
    rows = [(k, " ".join(form + [f"v{rng.randrange(10**6)}" for _ in range(40)])) for k in range(1500)]
    for k in (40, 900):
        rows.append((5000 + k, rows[k][1].rsplit(" ", 12)[0] + " " + " ".join(f"u{i}" for i in range(12))))
    found = O.near_duplicates(make_docs(rows), k=60, picked=1, sketches=2).collect()  # all texts in the same buckets
    assert len({r.class_id for r in found}) == 1500
    assert sorted(r.doc_id for r in found if r.class_size > 1) == [40, 900, 5040, 5900]


def spread_edits(rng, words, edits):
    """The words with so many substitutions, deletions and insertions at random places."""
    out = list(words)
    for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
        kind = rng.randrange(3)
        out[at : at + 1] = [] if kind == 0 else [f"new{rng.randrange(10**6)}"] if kind == 1 else [out[at], f"new{rng.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("lengths", [range(5, 21), range(21, 200, 9)])
def test_recall_at_many_edits(make_docs, lengths):
    """At 10 to 20 % edits, pairs that brute force links are found at the stated rate."""
    rng = random.Random(17)
    rows, near = [], []
    for n in lengths:
        for share in (0.1, 0.15, 0.2) * 5:
            base = [f"w{rng.randrange(4000)}" for _ in range(n)]
            other = spread_edits(rng, base, max(1, int(share * n)))
            if 0 < plain_distance(base, other) <= 0.2 * max(len(base), len(other)) + 1e-9:
                near.append(len(rows))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    sizes = {r.doc_id: r.class_size for r in O.near_duplicates(make_docs(rows)).collect()}
    assert len(near) > 150
    assert sum(sizes[k] > 1 for k in near) >= O.RECALL * len(near) - 1


def test_schemes_meet_with_the_stated_probability():
    for similarity in (0.7, 0.8, 0.9):
        ranges = O.schemes(similarity)
        for longer in range(2, 1000):
            edits = int((1 - similarity) * longer + 1e-9)
            low, high, k, picked, sketches = next(r for r in ranges if longer <= r[1])
            assert low <= longer - edits  # the shorter text has these sketches too
            if edits:
                assert 1 - (1 - O.meeting(longer, similarity, k, picked)) ** sketches >= O.RECALL - 1e-3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), min_size=2, max_size=8), st.sampled_from([0.5, 0.8]))
def test_the_bound_excludes_no_near_pair(texts, similarity):
    n = np.array([len(text) for text in texts])
    bags = np.array([np.bincount(np.array(text) % 4, minlength=O.BINS) for text in texts]).astype(np.uint8)
    none = np.zeros(len(texts), bool)
    pairs = set(zip(*map(np.ndarray.tolist, O.possible_pairs(n, np.arange(len(texts)), bags, none.astype(int), none, similarity))))
    for j, b in enumerate(texts):
        for i, a in enumerate(texts[:j]):
            if plain_distance(a, b) <= (1 - similarity) * max(len(a), len(b)):
                assert (i, j) in pairs


def test_dropping_keeps_columns(make_docs, corpus):
    docs = make_docs(corpus)
    left = O.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == len(brute_classes(corpus))
    assert O.drop_near_copies(docs.where("doc_id < 0")).count() == 0
    assert O.near_duplicates(docs.where("doc_id is null and text is null")).count() == 1


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 300)] + [(500, 501), (501, 500), (7, 7)]
    links += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    parent: dict[int, int] = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    nodes = {i for a, b in links if a != b for i in (a, b)}
    assert set(found) == nodes
    assert len({(found[i], find(i)) for i in nodes}) == len({found[i] for i in nodes}) == len({find(i) for i in nodes})


def test_bound_tells_long_texts_with_many_other_words_apart():
    rng = np.random.default_rng(5)
    first = [f"w{i}" for i in rng.integers(0, 50_000, 800)]
    second = [f"v{i}" if rng.random() < 0.35 else word for i, word in enumerate(first)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([" ".join(first), " ".join(second)])], ["node", "text"])
    (bags,) = O._bags(iter([batch]))
    bags = np.frombuffer(b"".join(bags.column("bag").to_pylist()), np.uint8).reshape(2, -1)
    none = np.zeros(2, bool)
    a, b = O.possible_pairs(np.array([800, 800]), np.arange(2), bags, none.astype(int), none, 0.8)
    assert not len(a) and O.edit_distance(first, second, 160) is None


def other_words(rng, words, share):
    return [f"v{rng.randrange(10**6)}" if rng.random() < share else word for word in words]


def test_words_themselves_exclude_what_bins_let_pass():
    """Copies of one text that differ from each other by a little more than the threshold are not aligned in pairs."""
    rng = random.Random(7)
    first = [f"w{rng.randrange(300)}" for _ in range(800)]
    texts = [other_words(rng, first, 0.135) for _ in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([" ".join(text) for text in texts])], ["node", "text"])
    (bags,) = O._bags(iter([batch]))
    one = {"node": range(12), "n": [800] * 12, "label": range(12), "part": [0] * 12, "guest": [False] * 12, "bag": bags.column("bag"), "words": bags.column("words")}
    rows = [dict(zip(one, row)) for row in zip(*[column.to_pylist() if isinstance(column, pa.Array) else column for column in one.values()])]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("part", pa.int32()), ("guest", pa.bool_()), ("bag", pa.binary()), ("words", pa.binary())]))
    found = list(O._blocks(iter([pa.RecordBatch.from_arrays([pa.array([rows], kind)], ["rows"])]), 0.8))
    pairs = {pair for batch in found for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())}
    near = {(i, j) for j in range(12) for i in range(j) if O.edit_distance(texts[i], texts[j], 160) is not None}
    none = np.zeros(12, bool)
    dense = np.frombuffer(b"".join(bags.column("bag").to_pylist()), np.uint8).reshape(12, -1)
    binned = O.possible_pairs(np.full(12, 800), np.arange(12), dense, none.astype(int), none, 0.8)[0]
    assert near <= pairs and 4 * len(pairs) < len(binned)


def test_a_pair_of_many_buckets_is_made_once(spark, monkeypatch):
    """However many buckets two texts share, the blocks give their pair once."""
    rng = random.Random(8)
    first = [f"w{k}" for k in range(50)]
    texts = spark.createDataFrame([(k, " ".join(other_words(rng, first, 0.05))) for k in range(20)], "node LONG, text STRING")
    # Bucket b has all but one text, so that no two buckets have the same members.
    members = spark.createDataFrame([(b, k, 50, k) for b in range(-9, 9) for k in range(20) if k != b + 9], "bucket LONG, node LONG, n LONG, label LONG")
    monkeypatch.setattr(type(texts), "distinct", lambda rows: rows)
    made = [(r.a, r.b) for r in O._open_pairs(members, texts, 0.8).collect()]
    assert sorted(made) == [(i, j) for i in range(20) for j in range(i + 1, 20)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=12), min_size=2, max_size=8))
def test_word_lists_are_never_further_apart_than_the_texts(texts):
    lists = O.WordLists([np.sort(np.array(text, "<u2")).tobytes() for text in texts])
    for i, a in enumerate(texts):
        apart = lists.apart(i, np.arange(len(texts)))
        for j, b in enumerate(texts):
            most = max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total())
            assert apart[j] == (most if a and b else 0) <= plain_distance(a, b)


def test_rounds_end_when_they_link_few(make_docs, monkeypatch):
    """A round that links one pair of many is followed by the exact step, not by more rounds of leaders."""
    rng = random.Random(12)
    form = [f"f{k}" for k in range(60)]
    rows = [(k, " ".join(form + [f"v{rng.randrange(10**6)}" for _ in range(40)])) for k in range(60)]
    compared = []

    def one_link(pairs, texts, similarity):
        compared.append(pairs.count())
        return pairs.orderBy("a", "b").limit(1).withColumn("similarity", F.lit(0.9))

    monkeypatch.setattr(O, "_verified", one_link)
    found = O.near_duplicates(make_docs(rows), k=1, picked=1, sketches=4).collect()
    assert compared[0] > O.WORTH and compared[1:] == [0]
    assert sorted(r.class_size for r in found) == [1] * 58 + [2] * 2


def test_texts_are_aligned_a_few_at_a_time():
    texts = [f"word{k} " * 100_000 for k in range(6)]
    columns = [pa.array(range(6)), pa.array(range(6, 12)), pa.array(texts), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, ["a", "b", "text_a", "text_b"])
    found = list(O._linked(iter([batch]), 0.8))
    assert len(found) > 1 and pa.Table.from_batches(found).column("a").to_pylist() == list(range(6))


def test_labels_merged_round_by_round_are_those_of_all_links(spark):
    rng = random.Random(6)
    links = [(rng.randrange(120), rng.randrange(120, 240)) for _ in range(150)]
    labels = None
    for lo in range(0, 150, 50):
        labels = O.merged_labels(labels, spark.createDataFrame(links[lo : lo + 50], "a LONG, b LONG")).localCheckpoint()
    step = {r.node: r.label for r in labels.collect()}
    whole = {r.node: r.label for r in components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    assert set(step) == set(whole) and labels.count() == len(step)
    assert len({(step[i], whole[i]) for i in step}) == len(set(step.values())) == len(set(whole.values()))
