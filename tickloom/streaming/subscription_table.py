"""A table of subscriptions kept by a stream of client actions, readable as it stood after any micro-batch.

A micro-batch adds what its own actions say of each client and ticker, under its number, and then a commit; it
reads nothing of what was there before. A batch that runs again replaces its own rows, and rows without a commit
are not read. A version is the merge of all batches up to it. Every ``compact_every`` batches the merge is written
as a base, so that a reader takes the newest base and the few batches after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.routing import merge_parts, standing, standing_parts

_MOMENT = "STRUCT<ts: TIMESTAMP, seq: BIGINT>"
_PARTS = f"client_id STRING, ticker STRING, action STRING, at {_MOMENT}, opened {_MOMENT}, closed {_MOMENT}"


def upsert_sink(path: str, compact_every: int = 100) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that brings the table at ``path`` to the version of the batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        standing_parts(batch).write.mode("overwrite").parquet(f"{path}/changes/version={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _parts(spark, path, batch_id).write.mode("overwrite").parquet(f"{path}/bases/version={batch_id}")
            _commit(spark, f"{path}/compacted", batch_id)
        _commit(spark, f"{path}/commits", batch_id)

    return run


def _commit(spark: SparkSession, path: str, version: int) -> None:
    one = spark.range(1).select(F.lit(version).cast("long").alias("version"))
    one.write.mode("overwrite").parquet(f"{path}/{version}")


def _newest(spark: SparkSession, path: str, upto: int | None) -> int | None:
    """The largest committed version, up to one; none if nothing was committed."""
    try:
        found = spark.read.schema("version LONG").parquet(f"{path}/*")
    except AnalysisException:
        return None
    if upto is not None:
        found = found.where(F.col("version") <= upto)
    return found.agg(F.max("version")).first()[0]


def _parts(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Everything that the batches up to ``version`` say, one row per client and ticker."""
    schema = f"{_PARTS}, version LONG"
    base = _newest(spark, f"{path}/compacted", version)
    rows = spark.read.schema(schema).parquet(f"{path}/changes").where(F.col("version") <= version)
    if base is not None:
        rows = rows.where(F.col("version") > base)
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/bases").where(F.col("version") == base))
    return merge_parts(rows.drop("version"))


def newest_version(spark: SparkSession, path: str) -> int | None:
    return _newest(spark, f"{path}/commits", None)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``client_id, ticker, connected, active, wanted`` after the batch ``version``, by default the newest.

    ``routing.lists_of`` and ``routing.routes_of`` turn it into lists and routes.
    """
    newest = newest_version(spark, path)
    if newest is None or (version is not None and version > newest):
        raise ValueError(f"no version {'at all' if version is None else version} of {path}")
    return standing(_parts(spark, path, newest if version is None else version))
