"""What several operators share: scratch tables, file systems of tasks, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path

#: A word: what lies between runs of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of whole texts that Python gets at once. Spark's 10,000 are tens of MB, held by both sides for each task.
TEXT_ROWS = 1_000


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python ``rows`` rows at once, or fewer if the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; when they end, a worker that waits for its next task gives back what Arrow kept for reuse."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()


def saved(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that no later job computes it again.

    Python functions in it get ``batch_rows`` rows at once where that is given.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with batches_of(spark, batch_rows) if batch_rows else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path there of a folder given as Spark writes it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, otherwise as it is.

    ``df`` should be cheap to count, such as a saved table with narrow rows.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def known_join(facts: DataFrame, table: DataFrame, key: str, facts_per_key: str, n_facts: int) -> DataFrame:
    """Inner join of ``facts`` with ``table``, which has one row a key and counts the facts of each key.

    Keys with more than one in a hundred thousand of the facts (and over 200) are joined by broadcast, so that
    none of them lands in one task; by that rule there are at most 100,000 such keys. ``facts`` is read twice
    and should be a saved table.
    """
    many = max(200, n_facts // 100_000)
    hot = table.where(F.col(facts_per_key) > many)
    rare = table.where(F.col(facts_per_key) <= many)
    spread = facts.join(F.broadcast(hot), key)
    return spread.unionByName(facts.join(rare, key))


def bounded(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices whose texts or bytes in ``column`` are about ``most_bytes`` together.

    A longer one is alone in its slice, or with what came just before it.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if lo < hi:
            yield batch.slice(lo, hi - lo)
