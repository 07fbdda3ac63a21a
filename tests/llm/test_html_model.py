from __future__ import annotations

import time
from collections import Counter
from itertools import product

import pytest

from tickloom.llm import html_model as H

OWN = Counter()
for page in H.LABELLED_PAGES:
    OWN.update({cell: 40 * n for cell, n in H.count_page(page).items()})
MODEL = H.Model(dict(OWN))


def test_marginals_match_enumeration():
    page = "<body><div class=ad>Buy.</div><div><p>Some longer text, a sentence.</p><p>x</p></div></body>"
    nodes = H.tree_of(page)
    totals, content = 0.0, [0.0] * len(nodes)
    for labels in product((0, 1), repeat=len(nodes)):
        if labels[0]:
            continue
        p = 1.0
        for k, node in enumerate(nodes[1:], 1):
            a, b = labels[node.parent], labels[k]
            p *= MODEL.edges[H._edge(nodes, node)][2 * a + b]
            for value in H.features(node):
                p *= MODEL.of(value)[b]
        totals += p
        for k, label in enumerate(labels):
            content[k] += p * label
    assert MODEL.marginals(nodes) == pytest.approx([c / totals for c in content])


@pytest.mark.parametrize("left_out", range(len(H.LABELLED_PAGES)))
def test_pages_left_out_of_training(left_out):
    """Held-out accuracy over the characters of pages with other elements and names."""
    counts = Counter()
    for k, page in enumerate(H.LABELLED_PAGES):
        if k != left_out:
            counts.update({cell: 40 * n for cell, n in H.count_page(page).items()})
    model = H.Model(dict(counts))
    nodes = H.tree_of(H.LABELLED_PAGES[left_out])
    right = wrong = 0
    for node, p, label in zip(nodes, model.marginals(nodes), H.labels_of(nodes)):
        if node.text:
            right += len(node.text) * ((p > 0.5) == label)
            wrong += len(node.text) * ((p > 0.5) != label)
    assert right >= 0.8 * (right + wrong)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Start</a></li><li><a href="/b">More</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy it now, please.</div><article><h1>A title &amp; more</h1><p><b>First&nbsp;one.<br>goes  on
here<p>Second &lt;b&gt; &#233;.</p><ul><li>Point<li>Other point</ul></article>
<div class="comments"><p>I think this is a very good text, thanks.</p></div>
<form><p>Your mail address, please.</p></form><footer>&copy; Example. All rights.</footer></body></html>"""


def test_page():
    assert MODEL.extract(PAGE) == "A title & more\nFirst one. goes on here\nSecond <b> é.\nPoint\nOther point"


@pytest.mark.parametrize("page", ["", "<", "</p></div>", "<p", "<!--", "<script>", "&#0; &bogus;", "<div" * 300, "<b><i></b>", "<article>", "\x00<p>\x00"])
def test_broken_pages(page):
    assert isinstance(MODEL.extract(page), str)


def test_extraction_over_a_table(spark):
    rows = [(1, "u", PAGE, 7), (1, "u", PAGE, 7), (None, None, None, 0), (2, "v", "", 0), (3, "w", "<article><p>" + "Word here. " * 20_000, 1)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, n_chars INT")
    found = H.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    by = {r.page_id: r for r in found.collect()}
    assert found.count() == 5 and by[None].text == by[2].text == "" and by[2].n_chars == 0
    assert by[1].text.startswith("A title & more\n") and by[1].n_chars == len(by[1].text)
    assert by[3].n_chars == len("Word here. " * 20_000) - 1
    assert H.extract(pages.where("page_id > 9")).count() == 0


def test_corpus_pages_train_the_model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = H.train(pages, training_pages=20)
    assert model.counts["kind=article|1"] == 20 + OWN["kind=article|1"]
    for row in H.extract(pages, model).collect():
        source = next(r.html for r in pages.where(f"page_id = {row.page_id}").collect())
        body = source[source.index("<article>") : source.index("</article>")]
        assert row.text == MODEL.extract(f"<body>{body}</article></body>")
        break


ARTICLE = "<article><h1>A title</h1><p>A first sentence that is long enough. And a second one.</p></article>"
MAIN = "A title\nA first sentence that is long enough. And a second one."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><body>{ARTICLE}</body></html>",
        f"<html><head><meta charset=utf-8><title>T</title>{ARTICLE}",
        f"<html><head><title>T</title><template><p>no</p><body>{ARTICLE}",
        f"<body><svg><path d=M0><text>drawn</text>{ARTICLE}</body>",
        f"<body><select><option>one<option>two{ARTICLE}</body>",
        f"<body><a name=top>{ARTICLE}</body>",
        f"<body><ul class=menu><li><a href=/>Home</ul>{ARTICLE}</body>",
        f"<body><script>if (a<b && c=\"x) d();</script>{ARTICLE}<p class=\"footer\">Legal.</p></body>",
        f"<body><div title=5\">{ARTICLE}</div></body>",
    ],
)
def test_omitted_and_broken_ends(page):
    assert MODEL.extract(page) == MAIN


def test_what_stands_inside_a_sentence_does_not_cut_it():
    body = (
        "<p>Energy is <math><mi>E</mi><annotation>\\\\E</annotation></math> here, <svg><title>no</title><text>no</text></svg>as "
        "<script>no()</script>said. And so on.</p>"
    )
    assert MODEL.extract(f"<body><article><h1>A title</h1>{body}</article></body>") == "A title\nEnergy is E here, as said. And so on."


@pytest.mark.parametrize(
    "part", ["<a", "<p a=\"", "<p a='", "<!", "<?", "</a", "<a href=x>", "<div><li>", "<p ", "<svg><p>", "<!--", "<script", "<td><tr>", "=\"<"]
)
def test_a_megabyte_of_broken_markup_takes_bounded_time(part):
    began = time.process_time()
    MODEL.extract(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 60


def test_many_open_blocks_before_list_items():
    began = time.process_time()
    MODEL.extract("<div>" * 60_000 + "<li>x" * 60_000)
    assert time.process_time() - began < 60


def test_training_pages_are_chosen_by_hash_and_columns_pass(spark):
    pages = spark.createDataFrame([(i, f"<body>{ARTICLE}<p>{i % 5}</p></body>", "kept") for i in range(40)], "page_id LONG, html STRING, _html STRING")
    model = H.train(pages, training_pages=3)
    alone = Counter()
    for page in H.LABELLED_PAGES:
        alone.update({cell: H.OWN_WEIGHT * n for cell, n in H.count_page(page).items()})
    # Five distinct pages; three of them are counted, once each.
    assert model.counts["kind=article|1"] - alone["kind=article|1"] == 3
    rows = H.extract(pages, model).collect()
    assert {(r["_html"], r["text"]) for r in rows} == {("kept", MAIN)} and len(rows) == 40
    none = H.extract(pages.where("page_id < 0"))
    assert none.columns == ["page_id", "_html", "text", "n_chars"] and none.count() == 0
