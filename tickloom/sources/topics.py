"""Keyed topics: Kafka on a cluster, a folder of files where there is no broker.

The Kafka options need the public ``spark-sql-kafka-0-10`` connector on the classpath.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.normalize import to_messages

MESSAGE = "key STRING, value STRING, seq BIGINT, ts TIMESTAMP"

#: What one micro-batch reads at most where nothing else is asked for.
OFFSETS_PER_TRIGGER = 1_000_000
FILES_PER_TRIGGER = 100
_TOPIC_BITS, _PARTITION_BITS = 6, 12


def message_number(names: list[str], topic: Column, partition: Column, offset: Column) -> Column:
    """One number for (offset, partition, topic): messages of one time are ordered by it, the same way in each run.

    Holds offsets up to 2**45, 4,096 partitions and 64 topics.
    """
    if len(names) > 1 << _TOPIC_BITS:
        raise ValueError(f"more than {1 << _TOPIC_BITS} topics")
    place = F.array_position(F.array(*[F.lit(name) for name in sorted(names)]), topic) - 1
    number = F.shiftleft(offset, _PARTITION_BITS).bitwiseOR(partition.cast("long"))
    return F.shiftleft(number, _TOPIC_BITS).bitwiseOR(place)


def read_topic(
    spark: SparkSession,
    names: list[str],
    fmt: str = "kafka",
    per_trigger: int = 0,
    **options: str,
) -> DataFrame:
    """A stream of ``(key, value, seq, ts)`` from one or several topics, from the earliest offset.

    With ``kafka`` the names are topics; otherwise they are folders of files with these columns.
    ``per_trigger`` bounds the offsets, or the files, of one micro-batch; 0 stands for ``OFFSETS_PER_TRIGGER`` or
    ``FILES_PER_TRIGGER``, so that the first batch of a backfill is not the whole topic. ``seq`` is unique over the
    topics and their partitions and rises along each partition.
    """
    if fmt == "kafka":
        options["maxOffsetsPerTrigger"] = str(per_trigger or OFFSETS_PER_TRIGGER)
        topic = (
            spark.readStream.format("kafka")
            .option("subscribe", ",".join(names))
            .option("startingOffsets", "earliest")
            .options(**options)
            .load()
        )
        return topic.select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            message_number(names, F.col("topic"), F.col("partition"), F.col("offset")).alias("seq"),
            F.col("timestamp").alias("ts"),
        )
    options["maxFilesPerTrigger"] = str(per_trigger or FILES_PER_TRIGGER)
    streams = [
        spark.readStream.schema(MESSAGE).format(fmt).options(**options).load(name) for name in names
    ]
    first = streams[0]
    for other in streams[1:]:
        first = first.unionByName(other)
    return first


def write_topic(ticks: DataFrame, name: str, checkpoint: str, fmt: str = "kafka", **options: str) -> DataStreamWriter:
    """Publish a stream keyed by ticker; Kafka sends equal keys to one topic partition."""
    writer = _messages(ticks, fmt).writeStream.option("checkpointLocation", checkpoint).options(**options)
    return writer.format(fmt).option("topic" if fmt == "kafka" else "path", name)


def publish(ticks: DataFrame, name: str, fmt: str = "kafka", **options: str) -> None:
    """Publish a batch keyed by ticker."""
    writer = _messages(ticks, fmt).write.format(fmt).options(**options)
    if fmt == "kafka":
        writer.option("topic", name).save()
    else:
        writer.mode("append").save(name)


def _messages(ticks: DataFrame, fmt: str) -> DataFrame:
    return to_messages(ticks) if fmt == "kafka" else to_messages(ticks, keep=("seq", "ts"))


def read_quotes(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed quote documents ``(seq, ticker, body, fetched_at)`` as JSON lines."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("seq BIGINT, ticker STRING, body STRING, fetched_at TIMESTAMP").json(path)
