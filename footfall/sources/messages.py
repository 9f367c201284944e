"""The event stream: Kafka, or files with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.streaming.watch import lag_of

# What the Kafka source delivers, with key and value as text.
MESSAGES = (
    "key string, value string, topic string, partition int, offset long, timestamp timestamp"
)
TOPIC = "analytics-events"
# Bounds of a trigger unless others are asked for: a backlog is worked off in pieces.
MAX_MESSAGES, MAX_FILES = 1_000_000, 1_000


def kafka_messages(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    max_per_trigger: int = MAX_MESSAGES,
    min_partitions: int | None = None,
) -> DataFrame:
    """A topic from its earliest message on.

    Messages are keyed by tenant, so the topic partition of a large tenant is much
    longer than the others; ``min_partitions`` has several tasks read it.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(max_per_trigger),
    }
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    stream = spark.readStream.format("kafka").options(**options).load()
    texts = {name: F.col(name).cast("string") for name in ("key", "value")}
    return stream.withColumns(texts).select(
        "key", "value", "topic", "partition", "offset", "timestamp"
    )


def write_kafka(messages: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Send ``(key, value)`` rows; returns once all replicas have them."""
    (
        messages.select("key", "value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .option("topic", topic)
        .save()
    )


def file_messages(
    spark: SparkSession, folder: str, max_files_per_trigger: int = MAX_FILES
) -> DataFrame:
    """Messages from JSON files that keep appearing in ``folder``."""
    reader = spark.readStream.schema(MESSAGES)
    return reader.option("maxFilesPerTrigger", max_files_per_trigger).json(folder)


def write_files(messages: DataFrame, folder: str) -> None:
    messages.write.mode("append").json(folder)


def backlog(query: StreamingQuery) -> int | None:
    """How many messages the slowest topic partition is behind, if the source tells."""
    progress = query.lastProgress
    return lag_of(source["metrics"] for source in progress["sources"]) if progress else None
