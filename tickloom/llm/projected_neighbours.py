"""Nearest neighbours by cosine through a few stable projections and a kd-tree.

Unit vectors are projected on a few random Gaussian directions. Such projections are 2-stable: the squared
projected distance of two vectors, divided by their squared distance, follows the chi-square law with as many
degrees of freedom as there are directions (Sun et al.: SRS, Solving c-Approximate Nearest Neighbor Queries in High
Dimensional Euclidean Space with a Tiny Index, VLDB 2015). A kd-tree over the projections gives a query's
candidates by rising projected distance, each leaf is verified with the whole vectors, and the search ends once a
vector as near as the k-th best so far would have shown before with the probability ``confidence``.

The upper levels of the tree are fitted on a sample of about ``sample_rows`` distinct vectors; every vector is
indexed. They cut the table into cells, and cells with many rows into parts, so that a task never holds more than
about ``cell_rows`` vectors of one cell, and below them every part has a tree of its own. A query first searches
the part it lies in. The k-th best found there bounds its search in the cells that the stopping test leaves open.

Equal vectors are searched once, with their first k + 1 ids, which is all that a result can hold; so neither a
vector that very many rows share nor a query that is asked very often makes work.

Vectors that are null, empty, all zero, or hold null or not finite components take no part; nor do rows without an
id, and vectors of another length than most rows have. A row that repeats id and vector counts once; rows with
the query's id are its own. Ties go to the smaller id. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

DIMS, CONFIDENCE = 8, 0.95
SAMPLE_ROWS, CELL_ROWS, LEAF_ROWS = 20_000, 4096, 64
QUERIES_PER_TASK = 50_000
_QUERIES_AT_ONCE = 512
_LEAST_SAMPLE = 16
_SLACK = 1e-12


def chi_square_quantile(probability: float, freedom: int) -> float:
    """Where the chi-square distribution function reaches ``probability``."""

    def below(x: float) -> float:
        # The series of the lower incomplete gamma function.
        half, a = x / 2, freedom / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 0.0, float(freedom)
    while below(high) < probability:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < probability else (low, middle)
    return high


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. They are first scaled by powers of two, so that no square leaves its range."""
    scaled = _in_range(vectors)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _in_range(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, dtype=np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with the same row of ``b``, in double precision."""
    a, b = _in_range(a), _in_range(b)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def directions(length: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dims))


@dataclass(frozen=True)
class Cells:
    """The upper levels of the tree: node 1 is the top, node i has the children 2 i and 2 i + 1."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, wanted: int) -> Cells:
        """About ``wanted`` cells of equally many rows of ``sample``, cut along their widest sides."""
        most = max(1, len(sample) // _LEAST_SAMPLE)
        depth = max(0, math.ceil(math.log2(max(1, min(wanted, most)))))
        axis, cut = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
        held = {1: sample}
        for node in range(1, 1 << depth):
            own = held.pop(node)
            if len(own):
                axis[node] = np.argmax(np.ptp(own, axis=0))
                cut[node] = np.median(own[:, axis[node]])
            above = own[:, axis[node]] > cut[node]
            held[2 * node], held[2 * node + 1] = own[~above], own[above]
        return Cells(depth, axis, cut)

    def of(self, projected: np.ndarray) -> np.ndarray:
        node = np.ones(len(projected), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (projected[np.arange(len(projected)), self.axis[node]] > self.cut[node])
        return node


class Tree:
    """A kd-tree over projected points, down to leaves of at most ``leaf_rows`` points."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.leaves: list[np.ndarray] = []
        waiting = [np.arange(len(points))]
        while waiting:
            rows = waiting.pop()
            if len(rows) <= leaf_rows:
                self.leaves.append(rows)
                continue
            own = points[rows]
            axis, half = np.argmax(np.ptp(own, axis=0)), len(rows) // 2
            order = np.argpartition(own[:, axis], half)
            waiting += [rows[order[:half]], rows[order[half:]]]
        self.low = np.array([points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in self.leaves])


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    total = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        x = points[:, axis, None]
        total += np.maximum(np.maximum(low[:, axis] - x, x - high[:, axis]), 0.0) ** 2
    return total


def search(
    tree: Tree, vectors: np.ndarray, queries: np.ndarray, projected: np.ndarray, bound: np.ndarray, k: int, reach: float
) -> tuple[np.ndarray, np.ndarray]:
    """``(cosines, rows)`` of the ``k`` best unit ``vectors`` found for each unit query, -1 where there are fewer.

    Leaves come by rising projected distance. ``bound`` is the squared distance that a query need not look beyond;
    a query stops at the first leaf whose squared projected distance is above ``reach`` times its bound.
    """
    n = len(queries)
    best, rows = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
    bound = bound.copy()
    away = box_distances(projected, tree.low, tree.high)
    order = np.argsort(away, axis=1, kind="stable")
    active = np.arange(n)
    for step in range(len(tree.leaves)):
        leaf = order[active, step]
        active = active[away[active, leaf] <= reach * bound[active]]
        if not len(active):
            break
        leaf = order[active, step]
        for number in np.unique(leaf):
            asked, inside = active[leaf == number], tree.leaves[number]
            found = np.concatenate([best[asked], queries[asked] @ vectors[inside].T], axis=1)
            names = np.concatenate([rows[asked], np.broadcast_to(inside, (len(asked), len(inside)))], axis=1)
            top = np.argpartition(-found, k - 1, axis=1)[:, :k]
            best[asked], rows[asked] = np.take_along_axis(found, top, 1), np.take_along_axis(names, top, 1)
            bound[asked] = np.minimum(bound[asked], np.maximum(2 - 2 * best[asked].min(axis=1), 0.0) + _SLACK)
    return best, rows


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


_HIT = "query LONG, vec_id LONG, score DOUBLE"


def neighbours(
    queries: DataFrame,
    base: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    confidence: float = CONFIDENCE,
    sample_rows: int = SAMPLE_ROWS,
    cell_rows: int = CELL_ROWS,
    queries_per_task: int = QUERIES_PER_TASK,
    seed: int = 13,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``base`` with the largest cosine found for each query.

    Ids are long integers. Queries may be rows of ``base``; rows with the query's id are left out of its result.
    """
    spark = base.sparkSession
    named = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = named(base).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    empty = spark.createDataFrame([], "query_id LONG, rank INT, vec_id LONG, score DOUBLE")
    if lengths is None:
        return empty
    length, keep = lengths["length"], k + 1

    # Only the first k + 1 ids of equal vectors can be in a result; each task drops the others before the shuffle.
    first = Window.partitionBy("vector").orderBy("vec_id")
    rows = rows.where(F.size("vector") == length).withColumn("place", F.dense_rank().over(first)).where(F.col("place") <= keep)
    classes = rows.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "neighbour-classes")
    asked = named(queries).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")) & (F.size("vector") == length)).distinct()
    vectors = saved(asked.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()), "neighbour-queries")

    n, n_queries = classes.count(), vectors.count()
    if not n_queries:
        return empty
    span = 1 << 40
    chosen = F.pmod(F.xxhash64("vector"), F.lit(span)) < math.ceil(span * min(1.0, sample_rows / n))
    onto = directions(length, dims, seed)
    sample = np.array([row["vector"] for row in classes.where(chosen).select("vector").collect()], dtype=np.float64)
    sample = unit(sample.reshape(-1, length)) @ onto
    cells = Cells.fit(sample, math.ceil(n / cell_rows))
    reach = chi_square_quantile(confidence, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                projected = unit(_matrix(batch.column("vector"), length)) @ onto
                points = pa.FixedSizeListArray.from_arrays(pa.array(projected.ravel()), dims).cast(pa.list_(pa.float64()))
                cell = pa.array(cells.of(projected))
                yield pa.RecordBatch.from_arrays([*batch.columns, points, cell], [*batch.schema.names, "projected", "cell"])

    def placed(df: DataFrame) -> DataFrame:
        fields = [*df.schema.fields, T.StructField("projected", T.ArrayType(T.DoubleType())), T.StructField("cell", T.LongType())]
        return df.mapInArrow(place, T.StructType(fields))

    # At most one row for every _LEAST_SAMPLE / 2 rows of the sample.
    sides = [f(F.col("projected")[i]).alias(f"{name}{i}") for i in range(dims) for name, f in (("low", F.min), ("high", F.max))]
    boxes = placed(classes.select("vector")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *sides).collect()
    number = np.array([box["cell"] for box in boxes])
    low, high = (np.array([[box[f"{name}{i}"] for i in range(dims)] for box in boxes]) for name in ("low", "high"))
    parts = np.array([math.ceil(box["n"] / cell_rows) for box in boxes])
    parts_of = spark.createDataFrame(list(zip(number.tolist(), parts.tolist())), "cell LONG, parts INT")
    chunks = math.ceil(n_queries / queries_per_task)

    salted = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    points = placed(classes).join(F.broadcast(parts_of), "cell").withColumn("part", salted).drop("parts", "node")
    chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    visit = T.StructType([vectors.schema["query"], vectors.schema["vector"]])
    visit = visit.add("bound", T.DoubleType()).add("cell", T.LongType()).add("part", T.IntegerType())

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts that a query has to see: its own first, and with a bound the others in reach."""
        for batch in batches:
            for start in range(0, batch.num_rows, _QUERIES_AT_ONCE):
                own = batch.slice(start, _QUERIES_AT_ONCE)
                projected = unit(_matrix(own.column("vector"), length)) @ onto
                home = _home(projected)
                bound = own.column("bound").to_numpy(zero_copy_only=False)
                if np.isnan(bound).all():
                    query, cell, part = np.arange(own.num_rows), home, np.zeros(own.num_rows, dtype=np.int64)
                else:
                    near = box_distances(projected, low, high) <= reach * bound[:, None]
                    query, cell = np.nonzero(near)
                    times = parts[cell]
                    query, cell = np.repeat(query, times), np.repeat(cell, times)
                    part = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                    other = (cell != home[query]) | (part != 0)
                    query, cell, part = query[other], cell[other], part[other]
                columns = [*own.take(pa.array(query)).columns, pa.array(number[cell]), pa.array(part, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, visit.fieldNames())

    def _home(projected: np.ndarray) -> np.ndarray:
        """The box of the cell that each point lies in, or the nearest box where that cell has no rows."""
        return np.where(
            np.isin(own := cells.of(projected), number),
            np.argmax(number == own[:, None], axis=1),
            np.argmin(box_distances(projected, low, high), axis=1),
        )

    def match(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.array([], np.int64), np.array([], np.int64), np.array([]))]
        if left.num_rows and right.num_rows:
            raw = _matrix(right.column("vector").combine_chunks(), length)
            held, ids = unit(raw), right.column("ids").combine_chunks()
            sizes, flat = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            tree = Tree(_matrix(right.column("projected").combine_chunks(), dims))
            for start in range(0, left.num_rows, _QUERIES_AT_ONCE):
                some = left.slice(start, _QUERIES_AT_ONCE)
                given = _matrix(some.column("vector").combine_chunks(), length)
                query = some.column("query").to_numpy()
                bound = np.nan_to_num(some.column("bound").to_numpy(), nan=np.inf)
                _, rows = search(tree, held, unit(given), unit(given) @ onto, bound, keep, reach)
                at, column = np.nonzero(rows >= 0)
                row = rows[at, column]
                score = cosines(given[at], raw[row])
                # Every class stands for its ids; the best k + 1 of them are all that a result can need.
                times = sizes[row]
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                vec_id = flat[np.repeat(starts[row], times) + within]
                at, score = np.repeat(at, times), np.repeat(score, times)
                order = np.lexsort((vec_id, -score, at))
                at, score, vec_id = at[order], score[order], vec_id[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                good = rank < keep
                out.append((query[at[good]], vec_id[good], score[good]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query", "vec_id", "score"])

    def searched(given: DataFrame) -> DataFrame:
        spots = given.select("query", "vector", "bound").mapInArrow(visits, visit)
        spots = spots.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
        spots = spots.select("query", "vector", "bound", "cell", "part", "chunk")
        base_rows = points.select("vector", "ids", "projected", "cell", "part", chunk)
        key = ("cell", "part", "chunk")
        return spots.groupBy(*key).cogroup(base_rows.groupBy(*key)).applyInArrow(match, _HIT)

    home = saved(searched(vectors.withColumn("bound", F.lit(float("nan")))), "neighbour-home")
    kth = home.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    farthest = F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) + _SLACK
    bounds = kth.select("query", F.when(F.col("n") >= keep, farthest).alias("bound"))
    open_ended = F.coalesce("bound", F.lit(float("inf")))
    wide = searched(vectors.join(bounds, "query", "left").withColumn("bound", open_ended))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = home.unionByName(wide).withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    hits = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits"))

    answered = asked.withColumnRenamed("vec_id", "query_id").join(vectors.join(hits, "query").drop("query"), "vector")
    others = F.slice(F.filter("hits", lambda hit: hit["vec_id"] != F.col("query_id")), 1, k)
    each = answered.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
