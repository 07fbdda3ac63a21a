from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest

from tickloom.llm import risk_rules as R


def brute_counts(text: str) -> tuple[int, ...]:
    words = re.findall("[^ \t-\r]+", text)
    lines = [line for line in text.split("\n") if re.search("[^ \t-\r]", line)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, inside = Counter(windows), set()
    for k, window in enumerate(windows):
        if times[window] > 1:
            inside |= set(range(k, k + 5))
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside)


def test_counts_match_brute_force(odd_texts):
    rng = random.Random(1)
    texts = [text or "" for text in odd_texts if len(text or "") < 9000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += ["x y\nx y\n \nx y\r\nx y", "a b c d e\n" * 9]
    for text in texts:
        assert R.counts_of(text)[:5] == brute_counts(text)


def test_tail_is_exact():
    for n, p in ((1, 0.02), (30, 0.1), (200, 0.003), (57, 0.5)):
        share = Fraction(p)
        for k in range(n + 1):
            exact = float(sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)))
            assert R.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert R.binomial_tail(0, 0, 0.1) == 1.0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(3000):
        lang = ("en", "de", None)[k % 3] if k < 2900 else "rare"
        good = rng.random() < 0.8
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(30)]
        text = " ".join(words if good else [word + "***" for word in words])
        rows.append((k, text, lang))
        labels.append((k, int(good), 0))
    return rows, labels


def test_certified_rules_reject_junk_and_keep_the_rest(spark, make_docs, corpus):
    rows, labels = corpus
    docs = make_docs(rows + [(None, None, "en"), (9001, "", None), (9002, "too short", "en")])
    marked = spark.createDataFrame(labels + [(None, 1, 0), (0, None, 0)], "doc_id LONG, quality INT, toxic INT")
    judged = {r.doc_id: r for r in R.judge(docs, marked, risk=0.2).collect()}
    good = {i for i, quality, _ in labels if quality}
    common = [i for i in range(2900)]
    assert all(judged[i].kept for i in good)
    assert not any(judged[i].kept for i in common if i not in good)
    assert all(judged[i].kept for i in range(2900, 3000))  # too few labels to certify anything there
    assert judged[9001].base_failed and judged[None].base_failed and judged[9002].base_failed
    left = R.keep_good(docs, marked, risk=0.2)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, r in judged.items() if r.kept)


def test_cutoffs_hold_the_bound(spark, make_docs, corpus):
    """Every chosen cutoff passes the exact test when it is done anew, and no better one does."""
    rows, labels = corpus
    docs = make_docs(rows)
    marked = spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")
    measured = docs.selectExpr("doc_id", "coalesce(lang, '') AS stratum", "text").withColumn("counts", R.text_counts("text"))
    chosen = {r.stratum: r.cutoffs for r in R.certified_cutoffs(measured, marked, risk=0.2).collect()}
    tests = 4 * sum(len(grid) for _, grid in R.RULES.values())
    good = {i: quality for i, quality, _ in labels}
    for stratum in ("en", "de", "", "rare"):
        own = [(good[i], R.counts_of(text)) for i, text, lang in rows if (lang or "") == stratum]
        names = [part.split()[0] for part in R.COUNTS.split(", ")]
        for rule, (formula, grid) in R.RULES.items():
            above, below = (names.index(x) for x in formula.split(" / "))
            best = None
            for cutoff in grid:
                hit = [q for q, c in own if c[below] and c[above] / c[below] >= cutoff]
                n_good = sum(q for q, _ in own)
                if R.binomial_tail(sum(hit), n_good, 0.2 / len(R.RULES)) <= 0.05 / tests:
                    gain = (len(hit) - sum(hit)) / (len(own) - n_good) - 10 * sum(hit) / n_good
                    best = max(best or (gain, cutoff), (gain, cutoff))
            want = best[1] if best and best[0] > 0 else None
            assert chosen.get(stratum, {}).get(rule) == want, (stratum, rule)


def test_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    docs = make_docs([(1, "one two three four five six seven eight nine ten *** ***", "en"), (2, "short", None)])
    assert {r.doc_id: r.kept for r in R.judge(docs, none).collect()} == {1: True, 2: False}
    assert R.judge(docs.where("doc_id > 5"), none).count() == 0


def test_default_parameters_reject_junk_of_sf01(spark):
    """The symbols of junk are rejected in every language that has some hundreds of good labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    judged = R.judge(docs, labels, joint=True).where("NOT base_failed").cache()
    junk = judged.where("counts.n_symbols >= 0.15 * counts.word_chars")
    assert junk.where("NOT kept").count() >= 0.9 * junk.count() > 100
    good = judged.join(labels.groupBy("doc_id").agg({"quality": "min"}).where("`min(quality)` = 1"), "doc_id")
    for row in good.groupBy("stratum").agg({"kept": "count", "*": "count"}).collect():
        lost = good.where((good.stratum == row.stratum) & ~good.kept).count()
        assert lost <= 0.02 * row["count(kept)"]


def test_joint_steps_hold_the_bound(spark, make_docs, corpus):
    """At the default risk, also the smaller strata get their cutoffs; a stratum of a hundred does not."""
    rows, labels = corpus
    marked = spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")
    judged = {r.doc_id: r.kept for r in R.judge(make_docs(rows), marked, joint=True).collect()}
    good = {i for i, quality, _ in labels if quality}
    assert all(judged[i] for i in good) and not any(judged[i] for i in range(2900) if i not in good)
    assert all(judged[i] for i in range(2900, 3000))
    kept = {r.doc_id for r in R.keep_good(make_docs(rows), marked, joint=True).collect()}
    assert kept == {i for i, keep in judged.items() if keep}
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert R.judge(make_docs(rows[:5]), none, joint=True).where("kept").count() == 5
