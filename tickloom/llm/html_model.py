"""Main text of pages by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, each run of text between block boundaries is a leaf.
Every node has a hidden label, content or not. The joint distribution is a product over the tree: a prior at
the root, a potential for every parent and child (a table each for text, elements right in the body,
sections and named elements, and other elements), and for each node the probabilities of its features (kind of
element, words in class and id, and for text its length, its share of link text and whether it has sentence
marks). Sum-product messages go from the leaves to the root and back, which gives the exact marginal of every
node; leaves whose marginal for content is over one half are the main text.

The tables are trained by counting on labelled pages, with add-half smoothing: a few pages written down here
with their labels, and pages of the corpus that mark their content with ``article`` or ``main``. Of the latter
``training_pages`` are used at most, chosen by a hash of the page. The tables have a fixed number of cells.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import whole_text

TRAINING_PAGES = 2_000
#: How much a page written down here weighs against one of the corpus.
OWN_WEIGHT = 40

BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article main "
    "section nav header footer aside form fieldset blockquote pre figure figcaption address details summary "
    "dialog menu hr button select option textarea label legend center".split()
)
#: Their text is never shown as text of the page.
HIDDEN = frozenset(
    "script style head title template noscript svg foreignobject iframe object textarea select canvas video audio annotation "
    "annotation-xml".split()
)
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("head title style script base link meta noscript template object".split())
#: Open elements of these kinds end where a block begins that cannot be in them.
LEFT_BY_BLOCKS = {"p": frozenset(), "svg": frozenset(), "select": frozenset(("option", "hr")), "option": frozenset(("option", "hr"))}
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that begins closes open ones of these kinds, up to the given borders.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
CONTENT_WORDS = re.compile(r"(article|content|entry|post|story|main|body|text|prose|page)", re.I)
CHROME_WORDS = re.compile(
    r"(^|[-_ ])(ad|ads|advert\w*|banner|promo\w*|sponsor\w*)($|[-_ ])|nav|menu|footer|header|masthead|sidebar|side-bar|widget"
    r"|cookie|consent|notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|form|comment|disqus|reply|respon"
    r"|share|social|related|recommend|breadcrumb|pagination|pager|copyright|legal|(tool|top|bottom)-?bar|skip|tags",
    re.I,
)
# Nothing is matched twice, so broken markup takes linear time. A quote counts only behind an equals sign, and only if
# it is closed; what no > ends goes to the end of the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|data-content)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


@dataclass
class Node:
    """A block element or a run of text."""

    parent: int
    kind: str
    names: str = ""
    parts: list[str] | None = None
    link_chars: int = 0
    mark: str = ""
    text: str = field(default="", repr=False)


class _Open:
    """The open elements, and where those of each kind stand."""

    def __init__(self) -> None:
        self.stack = [(0, "")]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.hidden = 0

    @property
    def top(self) -> str:
        return self.stack[-1][1]

    def push(self, node: int, name: str) -> None:
        self.places[name].append(len(self.stack))
        self.stack.append((node, name))
        self.hidden += name in HIDDEN

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop()[1]
            self.places[name].pop()
            self.hidden -= name in HIDDEN

    def nearest(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0

    def close(self, name: str) -> None:
        depth = self.nearest(name)
        if depth:
            self.pop_to(depth)

    def close_for(self, name: str) -> None:
        """Close what the beginning of an element ends."""
        if self.nearest("head") and name not in IN_HEAD and (self.top == "head" or name == "body"):
            self.close("head")
        while name in BLOCKS and name not in LEFT_BY_BLOCKS.get(self.top, BLOCKS):
            self.pop_to(len(self.stack) - 1)
        if name in CLOSES:
            kinds, borders = CLOSES[name]
            border = max(map(self.nearest, borders))
            inside = []
            for kind in kinds:
                places = self.places.get(kind, [])
                inside += places[bisect_right(places, border) :][:1]
            if inside:
                self.pop_to(min(inside))


class _Links:
    """Whether text is link text. A link without an end ends with its block."""

    _BEGIN, _END = re.compile(r"<a\s", re.I), re.compile(r"</a[\s>]", re.I)

    def __init__(self, page: str) -> None:
        self.page, self.inside, self.closed = page, False, False
        self.next = {self._BEGIN: -1, self._END: -1}

    def _after(self, pattern: re.Pattern[str], at: int) -> int:
        if self.next[pattern] < at:
            found = pattern.search(self.page, at)
            self.next[pattern] = found.start() if found else len(self.page)
        return self.next[pattern]

    def begin(self, at: int, attributes: str) -> None:
        self.inside = "href" in attributes.lower()
        end = self._after(self._END, at)
        self.closed = end < len(self.page) and end < self._after(self._BEGIN, at)

    def at_block(self) -> None:
        self.inside = self.inside and self.closed


def tree_of(page: str) -> list[Node]:
    """Nodes in page order, parents before children; node 0 is the page."""
    nodes, opened, links = [Node(-1, "page")], _Open(), _Links(page)
    leaf: Node | None = None
    at = 0

    def add_text(raw: str) -> None:
        nonlocal leaf
        if opened.top == "head" and raw.strip():
            opened.close("head")
        if opened.hidden or not raw:
            return
        if leaf is None:
            if not raw.strip():
                return
            leaf = Node(opened.stack[-1][0], "text", parts=[])
            nodes.append(leaf)
        leaf.parts.append(raw)
        if links.inside:
            leaf.link_chars += len(raw)

    while (token := _TOKEN.search(page, at)) is not None:
        add_text(page[at : token.start()])
        at = token.end()
        name = (token.group(1) or "").lower()
        if not name:
            continue
        if token.group(0)[1] == "/":
            if name == "a":
                links.inside = False
            elif name in BLOCKS or name in HIDDEN:
                opened.close(name)
                if name in BLOCKS:
                    leaf = None
                    links.at_block()
            continue
        if name == "a":
            links.begin(at, token.group(2))
        if name == "br":
            add_text(" ")
        opened.close_for(name)
        if name not in BLOCKS and name not in HIDDEN:
            continue
        if name in BLOCKS:
            leaf = None
            links.at_block()
        if name in VOID or token.group(2).endswith("/"):
            continue
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(token.group(2))} if token.group(2) else {}
        names = " ".join(found.get(k, "") for k in ("class", "id", "role")) if found else ""
        nodes.append(Node(opened.stack[-1][0], name, names, mark=found.get("data-content", "")))
        opened.push(len(nodes) - 1, name)
        if name in RAW:
            close = re.compile(rf"</{name}\s*+>", re.I).search(page, at)
            at = close.end() if close else len(page)
            opened.pop_to(len(opened.stack) - 1)
    add_text(page[at:])
    for node in nodes:
        if node.parts is not None:
            node.text = " ".join(html.unescape("".join(node.parts)).split())
    return nodes


def _size(n: int) -> str:
    return "0" if n < 15 else "1" if n < 40 else "2" if n < 100 else "3" if n < 300 else "4"


def features(node: Node) -> tuple[str, ...]:
    """Values of the node's features, each with the feature's name in front."""
    if node.kind != "text":
        named = "none"
        if node.names.strip():
            named = "chrome" if CHROME_WORDS.search(node.names) else "content" if CONTENT_WORDS.search(node.names) else "other"
        return f"kind={node.kind if node.kind in BLOCKS else 'hidden'}", f"names={named}"
    text = node.text
    share = node.link_chars / max(1, sum(map(len, node.parts or ())))
    links = "0" if share == 0 else "1" if share < 0.3 else "2" if share < 0.8 else "3"
    return f"chars={_size(len(text))}", f"links={links}", f"sentence={int(bool(re.search(r'[.!?]', text)))}"


#: How many values a feature can take, for smoothing.
_VALUES = {"kind": len(BLOCKS) + 1, "names": 4, "chars": 5, "links": 4, "sentence": 2}


def labels_of(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that marks its content, otherwise None.

    ``data-content`` on an element labels what is inside it; ``article`` and ``main`` mark content, except for
    the parts of them whose kind says that they are something else.
    """
    if not any(node.mark or node.kind in ("article", "main") for node in nodes):
        return None
    labels = []
    for node in nodes:
        label = labels[node.parent] if node.parent >= 0 else 0
        if node.mark:
            label = int(node.mark == "1")
        elif node.kind in ("article", "main"):
            label = 1
        elif node.kind in ("nav", "footer", "aside", "form") or node.kind in HIDDEN:
            label = 0
        elif label and node.names and CHROME_WORDS.search(node.names) and not CONTENT_WORDS.search(node.names):
            label = 0
        labels.append(label)
    return labels


#: Elements that begin a part of a page.
SECTIONS = frozenset("article main section nav header footer aside form".split())
EDGES = ("to_text", "in_body", "to_section", "to_block")


def _edge(nodes: list[Node], node: Node) -> str:
    """Which table holds the potential between a node and its parent."""
    if node.kind == "text":
        return "to_text"
    if nodes[node.parent].kind in ("page", "html", "body"):
        return "in_body"
    return "to_section" if node.names.strip() or node.kind in SECTIONS else "to_block"


def count_page(page: str) -> Counter[str] | None:
    """Feature and parent-child counts of one labelled page."""
    nodes = tree_of(page)
    labels = labels_of(nodes)
    if labels is None:
        return None
    counts: Counter[str] = Counter()
    for node, label in zip(nodes, labels):
        if node.parent >= 0:
            counts[f"{_edge(nodes, node)}={labels[node.parent]}|{label}"] += 1
            counts.update(f"{value}|{label}" for value in features(node))
    return counts


class Model:
    """Log potentials from counts; marginals by sum-product."""

    def __init__(self, counts: dict[str, float]) -> None:
        self.edges: dict[str, tuple[float, float, float, float]] = {}
        for name in EDGES:
            cells = [[counts.get(f"{name}={a}|{b}", 0) + 0.5 for b in (0, 1)] for a in (0, 1)]
            self.edges[name] = tuple(cell / sum(row) for row in cells for cell in row)
        totals: Counter[tuple[str, int]] = Counter()
        for key, n in counts.items():
            value, _, label = key.rpartition("|")
            totals[value.partition("=")[0], int(label)] += n
        self.counts, self.totals = counts, totals
        self.known: dict[str, tuple[float, float]] = {}

    def of(self, value: str) -> tuple[float, float]:
        """Probability of a feature's value under either label."""
        if value not in self.known:
            name = value.partition("=")[0]
            pair = [(self.counts.get(f"{value}|{b}", 0) + 0.5) / (self.totals[name, b] + 0.5 * _VALUES[name]) for b in (0, 1)]
            self.known[value] = pair[0], pair[1]
        return self.known[value]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node."""
        n = len(nodes)
        edges = [self.edges[_edge(nodes, node)] for node in nodes]
        below0, below1 = [1.0] * n, [1.0] * n  # own evidence and all messages from children
        up0, up1 = [1.0] * n, [1.0] * n
        for k in range(n - 1, 0, -1):
            e0, e1 = below0[k], below1[k]
            for value in features(nodes[k]):
                p0, p1 = self.of(value)
                e0, e1 = e0 * p0, e1 * p1
            scale = e0 + e1
            e0, e1 = e0 / scale, e1 / scale
            below0[k], below1[k] = e0, e1
            stay0, to1, to0, stay1 = edges[k]
            m0, m1 = stay0 * e0 + to1 * e1, to0 * e0 + stay1 * e1
            up0[k], up1[k] = m0, m1
            parent = nodes[k].parent
            b0, b1 = below0[parent] * m0, below1[parent] * m1
            scale = b0 + b1
            below0[parent], below1[parent] = b0 / scale, b1 / scale
        out = [0.0] * n
        for k in range(1, n):
            parent = nodes[k].parent
            # The page itself is not content; elsewhere the parent's belief without this child's message.
            p1 = 0.0 if parent == 0 else out[parent]
            if parent:
                q0, q1 = (1 - p1) / up0[k], p1 / up1[k]
            else:
                q0, q1 = 1.0, 0.0
            stay0, to1, to0, stay1 = edges[k]
            d0, d1 = q0 * stay0 + q1 * to0, q0 * to1 + q1 * stay1
            b0, b1 = d0 * below0[k], d1 * below1[k]
            out[k] = b1 / (b0 + b1)
        return out

    def extract(self, page: str) -> str:
        nodes = tree_of(page)
        found = self.marginals(nodes)
        return "\n".join(node.text for node, p in zip(nodes, found) if node.text and p > 0.5)


# Pages with labels, for elements and names that a corpus may not show in labelled places.
_PROSE = "<p>The first sentence of a paragraph tells what the page is about, and others follow it. They go on.</p>"
LABELLED_PAGES = tuple(
    f"<html><body>{page}</body></html>"
    for page in (
        f"<header class='site-header' data-content='0'><a href=/>Home</a><p>All the news of the day.</p></header>"
        f"<nav data-content='0'><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></nav>"
        f"<div id='content' data-content='1'><h1>A headline of some length</h1>{_PROSE}{_PROSE}<h2>Short</h2><p>Yes.</p>"
        f"<blockquote>Someone said this.</blockquote><ul><li>One point.</li><li>Another point</li></ul></div>"
        f"<aside class='sidebar' data-content='0'><h3>Popular</h3><ul><li><a href=/c>Some story</a></li></ul></aside>"
        f"<footer data-content='0'><p>&copy; 2024 Example. All rights reserved.</p></footer>",
        f"<div class='cookie-notice' data-content='0'><p>We use cookies. By staying you agree to that.</p><button>OK</button></div>"
        f"<div class='menu' data-content='0'><ul><li><a href=/a>Start</a></li></ul></div>"
        f"<article class='post-content' data-content='1'><h1>Title</h1>{_PROSE}<table><tr><td>A cell</td><td>12</td></tr></table>"
        f"{_PROSE}<pre>some code</pre></article>"
        f"<div class='ad' data-content='0'>Buy this now. It is cheap.</div>"
        f"<section id='comments' data-content='0'><h3>Comments</h3><div class='comment'><p>I liked it, thanks a lot for "
        f"writing this text.</p></div><form><label>Your name</label><button>Send</button></form></section>",
        f"<header data-content='0'><h1>Site name</h1></header><main data-content='1'><section><h2>Part</h2>{_PROSE}</section>"
        f"<section>{_PROSE}<figure><figcaption>What is seen.</figcaption></figure></section>"
        f"<aside data-content='0'><p>Related: read this too.</p></aside>"
        f"<form data-content='0'><p>Subscribe to our letter.</p></form></main>"
        f"<div class='share' data-content='0'><a href=/t>Share</a></div><footer data-content='0'><ul><li><a href=/i>Imprint</a></li></ul></footer>",
        f"<h1 data-content='1'>A plain page</h1><p data-content='1'>A first sentence. And one more that is longer.</p>"
        f"<p data-content='1'>Then a second paragraph, which ends here.</p><ul data-content='1'><li>A point.</li></ul>"
        f"<p class='copyright' data-content='0'>Copyright 2024, all rights.</p><ul class='menu' data-content='0'><li><a href=/>Up</a></li></ul>",
        f"<div id='top-bar' data-content='0'><p>Call us on 555 0100, we are glad to help you.</p></div>"
        f"<div class='article-body' data-content='1'><h2>About a thing</h2>{_PROSE}{_PROSE}<ol><li>First.</li><li>Then this.</li></ol></div>"
        f"<div class='related' data-content='0'><h3>Read on</h3><p><a href=/x>Another long headline of another story</a></p></div>"
        f"<ol class='comment-list' data-content='0'><li><p>What a fine article this is, I will come back.</p></li>"
        f"<li><p>Not so sure. The second part is wrong.</p></li></ol>"
        f"<section class='newsletter' data-content='0'><p>Get our letter every week. No spam.</p></section>",
        f"<div id='header' data-content='0'><p>The site of the town.</p></div><table class='layout'><tr>"
        f"<td class='sidebar' data-content='0'><ul><li><a href=/q>Weather</a></li></ul><p>Sponsored: buy things.</p></td>"
        f"<td class='content' data-content='1'><h1>News</h1>{_PROSE}{_PROSE}</td></tr></table>"
        f"<div id='footer' data-content='0'><p>Made by someone in 2024. Legal notice.</p></div>",
        f"<div class='banner' data-content='0'><p>Only today: half the price. Order now.</p></div>"
        f"<section class='entry' data-content='1'><h1>An entry</h1>{_PROSE}<dl><dt>Term</dt><dd>Its meaning.</dd></dl>{_PROSE}</section>"
        f"<section class='comments' data-content='0'><h2>Replies</h2><p>Thank you, this helped me a lot with my work.</p></section>"
        f"<section class='breadcrumb' data-content='0'><a href=/>Home</a> <a href=/n>News</a></section>",
    )
)


def train(pages: DataFrame, training_pages: int = TRAINING_PAGES, html_col: str = "html") -> Model:
    """A model from the pages written down here and from at most ``training_pages`` marked pages of ``pages``.

    Those with the smallest hashes are taken, equal pages once. The hashes are chosen first, so that no page moves
    that is not trained on.
    """
    marked = pages.select(whole_text(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    marked = marked.withColumn("at", F.xxhash64("html"))
    last = marked.select("at").distinct().orderBy("at").limit(training_pages).agg(F.max("at")).first()[0]
    chosen = marked.where(F.col("at") <= F.lit(last).cast("long")).groupBy("at").agg(F.first("html").alias("html")).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count_page(page) or {})
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(total), pa.string()), "n": pa.array(total.values(), pa.int64())})

    cells = chosen.mapInArrow(count, "cell STRING, n LONG").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts: Counter[str] = Counter({row.cell: row.n for row in cells})
    for page in LABELLED_PAGES:
        counts.update({cell: OWN_WEIGHT * n for cell, n in count_page(page).items()})
    return Model(dict(counts))


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` and with ``text`` and ``n_chars``, the main text and its code points.

    Blocks are joined by a line feed; inside a block all white space is one space. A null or empty page has an
    empty text. Rows are kept as they are, repeated ones too; other columns than ``text`` and ``n_chars`` pass.
    """
    model = model or train(pages, html_col=html_col)
    counts = model.counts
    kept = [name for name in pages.columns if name not in (html_col, "text", "n_chars")]
    # The page comes last; columns are told apart by place, so any other name may be there.
    wanted = pages.select(*[F.col(f"`{name}`") for name in kept], whole_text(html_col))
    schema = StructType([pages.schema[name] for name in kept]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(counts)
        for batch in batches:
            texts = [own.extract(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    return wanted.mapInArrow(run, schema)
