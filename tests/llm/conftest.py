from __future__ import annotations

import random

import pytest

DOCUMENT = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
#: Names that operators use inside; as extra columns they must do no harm.
CLASHING = "size INT, shard INT, key STRING, sha STRING, ids STRING, n INT, counts STRING, stratum STRING, block INT"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text[, lang[, source]])``, with extra columns whose names clash."""

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]))
            + (1, 2, "k", "h", "i", 3, "c", "t", 4)
            for r in rows
        ]
        return spark.createDataFrame(full, f"{DOCUMENT}, {CLASHING}").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and odd white space, very long texts, ties and repeats."""
    rng = random.Random(5)
    words = ["alpha", "Beta,", "don't", "(gamma)", "éclair", "x1", "it's.", "naïve!!", "日本語", "a|b"]
    long_text = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        None, "", " ", "\n\n", "  two  spaces ", "tab\there", "line one\nline two\nline one\n", "plain words here",
        "plain words here", "plain  words\there", "end.\nStart of next", "A B c", "é combining", "🙂 smile", long_text,
        "<|endoftext|> is text", "we're they'll 'tis 'S", "x" * 5000, "1234 56,78 % & #",
    ]
