"""Near duplicates by Order MinHash, verified by banded alignment.

Texts become lower-case words. Equal texts are one node. Each run of ``k`` words is labelled with how often it
came before in the text; under each of ``sketches`` hash functions the ``picked`` labelled runs with the
smallest values are kept *in the order of the text* and hashed together (Marcais et al. 2019). Two texts agree
in a sketch with a probability that falls with their edit distance, including moved passages that plain
MinHash does not see.

Nodes that agree in a sketch share a bucket. A bucket is never expanded into pairs: each member is compared
with one leader of the bucket, in later rounds with ``LEADERS``, so the comparisons are linear in the number of
sketches. Comparisons are exact:
edit distance over words, computed within a band as wide as the distance may be. Texts whose
distance is at most ``1 - similarity`` of the longer one are linked, and classes are the connected components
of the links. As long as at least one in ``WORTH`` comparisons of a round is a link, another one follows with
other leaders, over the buckets which then still hold several classes.

Leaders only make the classes few. What they leave open is settled exactly: in every bucket that still holds
several classes, each two members of different classes are aligned unless a bound excludes them. Members are
compared in blocks of about ``BLOCK``, within reach of each other's length; the bound is the distance of their
word counts, first in ``BINS`` bins and then of the words themselves, as 16-bit hashes, which is never above the
edit distance. So every pair of texts that agrees in a sketch is in one class, aligned or excluded, however large
the bucket. The rows of this step grow with the square of the blocks of a bucket.

Runs, picks and sketches follow from the length of a text and the similarity (:func:`schemes`). ``d`` edits of a
text of ``n`` words leave at least ``n - k + 1 - k d`` of its runs of ``k`` words; if ``s`` of ``u`` runs of two
texts are common, a sketch of ``p`` picks agrees with probability ``C(s, p) / C(u, p)`` where the common runs keep
their order. The most selective runs and picks are taken with which ``MOST_SKETCHES`` sketches or fewer let two
texts at the threshold meet with probability ``RECALL`` even if the edits are spread evenly, and as many sketches
as that takes. At 0.8, texts of up to 31 words have sketches of four words, longer ones of three runs of two. A
text whose partner may fall in the next range has the sketches of both.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, TEXT_ROWS, bounded, known_join, releasing, saved, small, whole_text
from .components import components

SIMILARITY, RECALL, MOST_SKETCHES = 0.8, 0.99, 72
#: Words of a run and runs picked, from selective to sensitive; and the longest text of the lower range.
CHOICES = ((5, 2), (3, 2), (2, 3), (1, 4), (1, 3), (1, 2), (1, 1))
SHORT, FAR = 31, 400
LEADERS, WORTH = 4, 20
#: Texts that a task holds as Python objects at once take about so many bytes.
HELD_BYTES = 2 << 20
#: Members of a bucket that are compared with each other at once, and bins of the word counts that exclude pairs; a
#: first look at pairs takes the counts folded to fewer bins.
BLOCK, BINS, FOLDED = 1024, 512, 64
#: Longer texts are not compared word by word before they are aligned, which bounds the memory of a block.
LISTED_WORDS = 4096
SKETCH = "node LONG, n LONG, bucket LONG"
BAGS = "node LONG, bag BINARY, words BINARY"
#: Blocks that Python gets at once.
BLOCK_ROWS = 64
_CELLS = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def meeting(n: int, similarity: float, k: int, picked: int) -> float:
    """At least this probability has a sketch to agree for a text of ``n`` words and one with all its edits."""
    edits = int((1 - similarity) * n + 1e-9)
    runs = n - k + 1
    common = runs - k * edits
    either = 2 * runs - common
    picked = min(picked, runs)
    return math.comb(common, picked) / math.comb(either, picked) if common >= picked > 0 else 0.0


def schemes(similarity: float, recall: float = RECALL) -> list[tuple[int, int, int, int, int]]:
    """``shortest, longest, k, picked, sketches`` for each range of lengths.

    Of two texts that may be linked both have the sketches of the range in which the longer one is.
    """
    found = []
    for low, high in ((1, SHORT), (SHORT + 1, 1 << 62)):
        # From FAR words on the probability changes by less than a hundredth.
        lengths = range(max(low, 2), min(high, FAR) + 1)
        best = None
        for k, picked in CHOICES:
            # A text without room for an edit only has equal partners, which are one node.
            least = min((meeting(n, similarity, k, picked) for n in lengths if int((1 - similarity) * n + 1e-9)), default=1.0)
            needed = 1 if least >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-least)) if least else None
            if needed and (best is None or needed < best[2]):
                best = (k, picked, needed)
            if needed and needed <= MOST_SKETCHES:
                best = (k, picked, needed)
                break
        k, picked, needed = best or (1, 1, MOST_SKETCHES)
        found.append((max(1, math.ceil(similarity * low - 1e-9)), high, k, picked, needed))
    return found


def labelled_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes, each with the number of equal runs before it.

    A text with fewer words has one run, all of it; one without words has none.
    """
    if not len(words):
        return words
    k = min(k, len(words))
    runs = np.zeros(len(words) - k + 1, np.uint64)
    for at in range(k):
        runs = runs * _ODD + words[at : len(words) - k + 1 + at]
    runs = _mixed(runs)
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if new.all():
        return runs
    first = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    times = np.empty(len(runs), np.uint64)
    times[order] = (np.arange(len(runs)) - first).astype(np.uint64)
    return _mixed(runs + times * _ODD)


def order_sketches(runs: np.ndarray, picked: int, seeds: np.ndarray) -> np.ndarray:
    """One hash for each seed: of the labelled runs with the smallest values, in text order."""
    picked = min(picked, len(runs))
    at = np.empty((len(seeds), picked), np.int64)
    step = max(1, _CELLS // max(1, len(runs)))  # so that a very long text takes no more memory than a batch
    for lo in range(0, len(seeds), step):
        some = seeds[lo : lo + step, None]
        values = runs[None, :] ^ some
        values *= some | np.uint64(1)
        values ^= values >> np.uint64(32)
        values *= _ODD
        # A few passes for the smallest value, the next one and so on; cheaper than dividing the rows.
        rows = np.arange(len(values))
        for turn in range(picked):
            least = values.argmin(axis=1)
            at[lo : lo + step, turn] = least
            values[rows, least] = _LAST
    at.sort(axis=1)
    out = seeds.copy()
    for column in range(picked):
        out = _mixed(out * _ODD + runs[at[:, column]])
    return out


def _word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the words of each text; every distinct word is hashed once."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    bounds = lists.offsets.to_numpy()
    coded = pc.dictionary_encode(lists.flatten())
    table = np.array([xxhash.xxh3_64_intdigest(word.encode()) for word in coded.dictionary.to_pylist()], np.uint64)
    hashes = table[coded.indices.to_numpy()]
    for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0]):
        yield hashes[a:b]


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, otherwise None.

    What both begin and end with is left out, then bands of growing width are tried.
    """
    if abs(len(a) - len(b)) > most:
        return None
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    same = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    left, right = Counter(a), Counter(b)
    if max((left - right).total(), (right - left).total()) > most:
        return None
    width = min(most, max(16, abs(len(a) - len(b))))
    while True:
        found = _in_band(a, b, width)
        if found <= width:
            return found
        if width == most:
            return None
        width = min(most, 4 * width)


def _in_band(a: list, b: list, width: int) -> int:
    """Edit distance along paths that stay within ``width`` of the diagonal (more than ``width`` if none is short).

    A column of the band is two bit vectors, of the places where the distance rises and falls by one from row
    to row (Myers 1999, in the banded form of Hyyro 2003); the band moves down one row with each column. The
    value is followed along the band's lower edge and then along the last row.
    """
    rows, width = len(a), min(width, max(len(a), len(b)))
    places: dict = {}
    for k, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << k)
    bits = 2 * width + 2
    mask, edge = (1 << bits) - 1, 1 << (bits - 1)
    rise, fall, value = mask ^ ((1 << (bits - width - 1)) - 1), 0, min(width, rows)
    if width > rows:  # the lower edge begins below the last row
        last = 1 << (bits - 2 - (width - rows))
    else:
        last = 1 << (bits - 2)
    at = width + 1 - bits
    for j, word in enumerate(b):
        equal = places.get(word, 0)
        equal = (equal >> at if at >= 0 else equal << -at) & mask
        diagonal = ((((equal & rise) + rise) ^ rise) | equal | fall) & mask
        up = fall | (mask ^ ((diagonal | rise) & mask))
        down = diagonal & rise
        if j < rows - width:
            value += not diagonal & edge
        else:
            value += bool(up & last) - bool(down & last)
            last >>= 1
        rise = down | (mask ^ (((diagonal >> 1) | up) & mask))
        fall = (diagonal >> 1) & up
        at += 1
    return value


def _linked(rows: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in rows for part in bounded(whole, 3, HELD_BYTES)):
        a_ids, b_ids, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for a, b, x, y in zip(a_ids, b_ids, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
            x, y = x.split(" "), y.split(" ")
            longer = max(len(x), len(y))
            found = edit_distance(x, y, int((1 - similarity) * longer + 1e-9))
            if found is not None:
                out.append((a, b, 1 - found / longer))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())],
            ["a", "b", "similarity"],
        )


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links among the pairs ``(a, b)``, each with the similarity of its texts."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    few = small(pairs)
    both = b.join(few, "b")
    if few is pairs:
        both = a.join(both, "a")
    else:  # bounded pairs: fetch the leaders' texts alone instead of moving all texts
        leaders = saved(a.join(small(pairs.select("a").distinct()), "a"), "leader-texts")
        both = saved(both, "member-texts").join(leaders, "a")
    rows = both.select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(lambda batches: releasing(_linked(batches, similarity)), "a LONG, b LONG, similarity DOUBLE")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words of each text in each of ``BINS`` bins, up to 255, a byte each, and its words in two bytes each."""
    for batch in (part for whole in batches for part in bounded(whole, 1, HELD_BYTES)):
        bags, lists = [], []
        for words in _word_hashes(batch.column(1)):
            bags.append(np.minimum(np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
            lists.append(np.sort(words.astype("<u2")).tobytes() if len(words) <= LISTED_WORDS else b"")
        arrays = [batch.column(0), pa.array(bags, pa.binary()), pa.array(lists, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "bag", "words"])


class WordLists:
    """The words of the texts of a block, as :func:`_bags` lists them; an empty list stands for an unknown one."""

    def __init__(self, lists: list[bytes]) -> None:
        self.words = np.frombuffer(b"".join(lists), "<u2")
        self.n = np.array([len(raw) // 2 for raw in lists], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        # How many equal words of the text stand before each word: they are sorted.
        new = np.ones(len(self.words), bool)
        new[1:] = self.words[1:] != self.words[:-1]
        new[self.begin[self.n > 0]] = True
        place = np.arange(len(self.words))
        self.before = place - np.maximum.accumulate(np.where(new, place, 0))

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """At most the edit distance of text ``i`` and each other one: the words of the longer without those that both have."""
        own, each = self.n[i], self.n[others]
        times = np.bincount(self.words[self.begin[i] : self.begin[i] + own], minlength=1 << 16)
        at = np.arange(each.sum()) + np.repeat(self.begin[others] - (np.cumsum(each) - each), each)
        shared = times[self.words[at]] > self.before[at]
        both = np.bincount(np.repeat(np.arange(len(others)), each), shared, len(others))
        return np.where((own > 0) & (each > 0), np.maximum(own, each) - both, 0)


def possible_pairs(
    n: np.ndarray, label: np.ndarray, bags: np.ndarray, part: np.ndarray, guest: np.ndarray, similarity: float, words: WordLists | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block that no bound excludes.

    Of each pair one member at least is no guest, and if the block has two parts the members are of different ones.
    An edit changes each of the two counts of words that only one side has by one at most, and so do bins, hashes and
    the limit of 255 to no more than that.
    """
    lefts, rights = [], []
    bags = bags.astype(np.int16)
    totals = bags.sum(axis=1, dtype=np.int64)
    folded = bags.reshape(len(bags), -1, FOLDED).sum(axis=1, dtype=np.int32)
    two = part.min() != part.max()
    for i in np.flatnonzero(~guest):
        ok = (label != label[i]) & (guest | (np.arange(len(n)) > i))
        if two:
            ok &= part != part[i]
        most = np.floor((1 - similarity) * np.maximum(n, n[i]) + 1e-9)
        at = np.flatnonzero(ok & (np.abs(n - n[i]) <= most))
        if not len(at):
            continue
        for counts in (folded, bags):
            apart = np.abs(counts[at] - counts[i]).sum(axis=1, dtype=np.int64) + np.abs(totals[at] - totals[i])
            at = at[apart <= 2 * most[at]]
        if words is not None and len(at):
            at = at[words.apart(i, at) <= most[at]]
        lefts.append(np.full(len(at), i))
        rights.append(at)
    if not lefts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(lefts), np.concatenate(rights)


def meet_first(i: np.ndarray, j: np.ndarray, before: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether the pairs share none of the buckets ``before``, those of member ``k`` being ``before[begin[k]:begin[k + 1]]``."""
    names, codes = np.unique(before, return_inverse=True)
    held = np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * len(names) + codes
    each = np.diff(begin)[j]
    at = np.arange(each.sum()) + np.repeat(begin[j] - (np.cumsum(each) - each), each)
    pair = np.repeat(np.arange(len(i)), each)
    shared = np.isin(i[pair] * len(names) + codes[at], held)
    return np.bincount(pair, shared, len(i)) == 0


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of each block; a pair comes from the smallest bucket alone in which both are, if these are given."""
    for batch in batches:
        bounds = batch.column("rows").offsets.to_numpy()
        flat = batch.column("rows").flatten()
        column = {name: flat.field(name) for name in ("node", "n", "label", "part", "guest")}
        node, n, label, part = (column[name].to_numpy() for name in ("node", "n", "label", "part"))
        guest = column["guest"].to_numpy(zero_copy_only=False)
        bounds = bounds - bounds[0]
        for block, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            at = slice(lo, hi)
            # The bags and words of one block at a time: they are most of a batch.
            bags = np.frombuffer(b"".join(flat.field("bag").slice(lo, hi - lo).to_pylist()), np.uint8).reshape(-1, BINS)
            words = WordLists(flat.field("words").slice(lo, hi - lo).to_pylist())
            i, j = possible_pairs(n[at], label[at], bags, part[at], guest[at], similarity, words)
            if len(i) and "bucket" in batch.schema.names:
                own = flat.field("buckets").slice(lo, hi - lo)
                begin = own.offsets.to_numpy().astype(np.int64)
                buckets = own.flatten().to_numpy()
                smaller = buckets < batch.column("bucket")[block].as_py()
                begin = np.concatenate(([0], np.cumsum(smaller)))[begin - begin[0]]
                first = meet_first(i, j, buckets[smaller], begin)
                i, j = i[first], j[first]
            if len(i):
                a, b = node[at][i], node[at][j]
                arrays = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])


def _open_pairs(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``(a, b)`` of different classes that share one of the buckets and that no bound excludes.

    ``members`` has ``bucket, node, n, label``. Buckets with the same members count once. Members are dealt to
    bands of length, a band as wide as lengths may differ, and each is a guest in the next band; a band with
    more than ``BLOCK`` rows is divided into parts, and each two parts meet in a block. A pair that shares several
    buckets is made in one of them.
    """
    same = members.groupBy("bucket").agg(
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("y"), F.count(F.lit(1)).alias("n_here")
    )
    once = saved(same.groupBy("x", "y", "n_here").agg(F.min("bucket").alias("bucket")).select("bucket", "n_here"), "near-open-buckets")
    rows = known_join(members, once, "bucket", "n_here", members.count())
    nodes = saved(rows.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "near-open-nodes")
    bags = saved(texts.join(small(nodes.select("node")), "node", "left_semi").mapInArrow(lambda batches: releasing(_bags(batches)), BAGS), "near-bags", TEXT_ROWS)
    # Of two lengths the longer is at most 1 / similarity times the shorter, so their bands are at most one apart.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(similarity) + 1e-9))
    bands = F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))
    rows = rows.select("bucket", "node", "n", "label", F.explode(bands).alias("at")).select("bucket", "node", "n", "label", "at.*")
    rows = saved(rows, "near-open")
    cell = F.xxhash64("bucket", "band")
    sizes = rows.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((~F.col("guest")).cast("int")).alias("own"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = sizes.where("own > 0 AND low <> high").select(cell.alias("cell"), "n_rows")
    sizes = saved(sizes.groupBy("cell").agg(F.sum("n_rows").alias("n_rows")), "near-open-sizes")
    rows = known_join(rows.withColumn("cell", cell), sizes, "cell", "n_rows", rows.count())
    half = BLOCK // 2
    parts = F.when(F.col("n_rows") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("n_rows") / half)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.join(bags.join(nodes, "node"), "node")
    one = F.struct("node", "n", "label", "part", "guest", "bag", "words", "buckets")
    key = [F.col("bucket"), F.col("band"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    blocks = rows.groupBy(*key).agg(F.collect_list(one).alias("rows")).select("bucket", "rows")
    # The block of one part alone holds its members once; the block of two parts holds both.
    found = blocks.mapInArrow(lambda batches: releasing(_blocks(batches, similarity)), "a LONG, b LONG")
    return found.distinct()


def _relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the present label of each node, itself where it has no link yet."""
    known = members.drop("label").join(labels.withColumnRenamed("label", "new"), "node", "left")
    return known.withColumn("label", F.coalesce("new", "node")).drop("new")


def merged_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of all nodes once there are more links: only the labels that these touch are connected anew."""
    if labels is None:
        return components(links)
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("to_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("to_b"))
    ends = links.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    ends = ends.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    moved = saved(components(saved(ends.where("a <> b").distinct(), "near-ends")), "near-moved")
    then = small(moved.select(F.col("node").alias("label"), F.col("label").alias("then")))
    kept = labels.join(then, "label", "left").select("node", F.coalesce("then", "label").alias("label"))
    return kept.unionByName(moved.join(labels.select("node"), "node", "left_anti"))


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    k: int | None = None,
    picked: int | None = None,
    sketches: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: ``doc_id, class_id, class_size, class_texts, kept``.

    ``class_id`` is the smallest document id of the class, ``class_size`` its documents, ``class_texts`` its
    different texts; ``kept`` is true for one document of each class. Letter case and white space do not count.
    Texts without words are one class. A null text has no words; null ids rank last; of rows that repeat id and
    text one is kept. Other columns are ignored; an empty table gives no rows. ``k``, ``picked`` and ``sketches``
    replace what :func:`schemes` chooses for every length.
    """
    spark = docs.sparkSession
    plain = F.trim(F.regexp_replace(F.lower(whole_text(text_col)), SPACE, " "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain.alias("text"))
    rows = rows.withColumn("key", F.sha2("text", 256))
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    texts = nodes.select("node", "text").where("text <> ''")
    rng = np.random.default_rng(20_190)
    ranges = [(lo, hi, k or k_, picked or p_, sketches or m_) for lo, hi, k_, p_, m_ in schemes(similarity)]
    ranges = [(lo, hi, k_, p_, rng.integers(1, 2**63, m_, dtype=np.uint64)) for lo, hi, k_, p_, m_ in ranges]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, 1, HELD_BYTES)):
            found, sizes, times = [], [], []
            for words in _word_hashes(batch.column(1)):
                own = [order_sketches(labelled_runs(words, k), picked, seeds) for lo, hi, k, picked, seeds in ranges if lo <= len(words) <= hi]
                found += own
                sizes.append(len(words))
                times.append(sum(map(len, own)))
            each = np.repeat(np.arange(batch.num_rows), times)
            ids = batch.column(0).to_numpy()
            buckets = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[each]), pa.array(np.array(sizes, np.int64)[each]), pa.array(buckets)], ["node", "n", "bucket"]
            )

    sketched = saved(texts.mapInArrow(lambda batches: releasing(sketch(batches)), SKETCH), "near-sketches", TEXT_ROWS)
    shared = sketched.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = saved(shared, "near-buckets")
    members = saved(known_join(sketched, shared, "bucket", "members", sketched.count()), "near-members")
    n_members = members.count()
    labels, turn = None, 0
    while True:
        known = members.withColumn("label", F.col("node")) if labels is None else _relabelled(members, labels)
        chosen = [
            F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "node").alias("h"), "node", "n", "label"))
            for k in range(1 if turn == 0 else LEADERS)
        ]
        mixed = F.min("label") != F.max("label")
        leaders = known.groupBy("bucket").agg(F.array_distinct(F.array(*chosen)).alias("leaders"), F.first("members").alias("n_here"), mixed.alias("mixed"))
        leaders = saved(leaders.where("mixed").drop("mixed"), "near-leaders")
        # From now on only the buckets with several classes count.
        members = saved(known_join(known, leaders, "bucket", "n_here", n_members), "near-members")
        pairs = members.select("node", "n", "label", F.explode("leaders").alias("first"))
        longer, shorter = F.greatest("n", "first.n"), F.least("n", "first.n")
        close = longer - shorter <= F.floor((1 - similarity) * longer + 1e-9)
        pairs = pairs.where((F.col("label") != F.col("first.label")) & close)
        pairs = saved(pairs.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
        unsettled, members = members, members.select("bucket", "node", "n", "members")
        found = saved(_verified(pairs, texts, similarity), "near-links", TEXT_ROWS)
        n_found = found.count()
        if n_found:
            labels = saved(merged_labels(labels, found), "near-labels")
        if n_found * WORTH < max(pairs.count(), 1):
            break
        turn += 1
    if n_found:
        unsettled = saved(_relabelled(unsettled, labels), "near-members")
    rest = saved(_open_pairs(unsettled.select("bucket", "node", "n", "label"), texts, similarity), "near-pairs", BLOCK_ROWS)
    found = saved(_verified(rest, texts, similarity), "near-links", TEXT_ROWS)
    if not found.isEmpty():
        labels = saved(merged_labels(labels, found), "near-labels")
    if labels is None:
        labels = spark.createDataFrame([], "node LONG, label LONG")
    labelled = nodes.drop("text").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = saved(labelled, "near-classes")
    classes = labelled.groupBy("label").agg(
        F.min("first_doc").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("class_texts"),
        F.min(F.struct(F.coalesce("first_doc", F.lit((1 << 63) - 1)), "key")).alias("best"),
    )
    placed = known_join(labelled.select("key", "label", "copies"), saved(classes, "near-sizes"), "label", "class_texts", labelled.count())
    placed = saved(placed.withColumn("best_key", F.col("best.key")).drop("best", "label"), "near-placed")
    documents = saved(rows.select("doc_id", "key").withColumn("row", F.monotonically_increasing_id()), "near-rows")
    n_rows = documents.count()
    first_row = documents.groupBy("key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row")).alias("first_row"))
    placed = placed.join(first_row, "key")
    joined = known_join(documents, saved(placed, "near-result"), "key", "copies", n_rows)
    kept = (F.col("key") == F.col("best_key")) & (F.col("row") == F.col("first_row.row"))
    return joined.select("doc_id", "class_id", "class_size", "class_texts", kept.alias("kept"), F.col("key").alias("text_key"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""

    def key(sha: str) -> Column:
        return F.concat_ws(":", F.col("doc_id").cast("string"), F.col(sha)).alias("_near_key")

    kept = near_duplicates(docs, similarity, **options).where("kept").select(key("text_key"))
    plain = F.trim(F.regexp_replace(F.lower(whole_text()), SPACE, " "))
    keyed = docs.withColumn("_near_sha", F.sha2(plain, 256))
    keyed = keyed.withColumn("_near_key", key("_near_sha")).drop("_near_sha")
    return keyed.join(kept, "_near_key", "left_semi").dropDuplicates(["_near_key"]).drop("_near_key")
