"""The stored table of points: one row per tick, partitioned by UTC date."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import columns as C
from ..operators.reshape import to_points


def write_points(enriched: DataFrame, path: str, mode: str = "append") -> None:
    """Store enriched ticks.

    Range partitioning by (date, ticker, time) samples the rows, so a crowded date or ticker takes as
    many files as it needs, and each file covers few tickers, which lets a reader skip the others.
    """
    points = to_points(enriched).withColumn("dt", C.utc_date(F.col("ts")))
    (
        points.repartitionByRange("dt", "ticker", "ts", "seq")
        .sortWithinPartitions("dt", "ticker", "ts", "seq")
        .write.mode(mode)
        .partitionBy("dt")
        .parquet(path)
    )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_LIVE = "version LONG, run STRING"
_RUN = re.compile(r"[\w.-]+")
#: Before the name in a folder, so that no name is read back as a number or a date.
_PREFIX = "run-"


def commit_points(enriched: DataFrame, path: str, run: str) -> None:
    """Store enriched ticks as ``run``, which replaces what a run of this name stored before.

    The rows are written first and then the list of runs that count, so a reader sees all of a run or nothing of it,
    and a run that broke off is simply made again. One writer at a time.
    """
    if not _RUN.fullmatch(run):
        raise ValueError(f"a run is named by letters, digits, dots, dashes and underscores, not {run!r}")
    spark = enriched.sparkSession
    _commit_run(to_points(enriched), path, run, [*_live_runs(spark, path), run])


def compact_points(spark: SparkSession, path: str, run: str) -> None:
    """Put all committed runs into one, named ``run``, with few files for each date."""
    runs = _live_runs(spark, path)
    if run in runs:
        raise ValueError(f"{run!r} is one of the runs to be put together")
    _commit_run(read_committed(spark, path).drop("dt"), path, run, [run])


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The points of the committed runs; a filter on ``dt`` skips the folders of other dates."""
    points = spark.read.parquet(f"{path}/data")
    return points.where(F.col("run").isin([_PREFIX + run for run in _live_runs(spark, path)])).drop("run")


def _commit_run(points: DataFrame, path: str, run: str, live: list[str]) -> None:
    spark = points.sparkSession
    dated = points.withColumn("dt", C.utc_date(F.col("ts")))
    placed = dated.repartitionByRange("dt", "ticker", "ts", "seq").sortWithinPartitions("dt", "ticker", "ts", "seq")
    placed.write.mode("overwrite").partitionBy("dt").parquet(f"{path}/data/run={_PREFIX}{run}")
    version = _newest(spark, path) + 1
    rows = [(version, name) for name in dict.fromkeys(live)]
    spark.createDataFrame(rows, _LIVE).coalesce(1).write.mode("overwrite").parquet(f"{path}/live/{version}")


def _lists(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LIVE).parquet(f"{path}/live/*")
    except AnalysisException:  # nothing was ever committed
        return spark.createDataFrame([], _LIVE)


def _newest(spark: SparkSession, path: str) -> int:
    newest = _lists(spark, path).agg(F.max("version")).first()[0]
    return -1 if newest is None else newest


def _live_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that count: one for each batch since the last compaction."""
    rows = _lists(spark, path).where(F.col("version") == _newest(spark, path)).select("run").collect()
    return sorted(row["run"] for row in rows)
