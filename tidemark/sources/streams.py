"""Streaming sources of change records, all with the Kafka record shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.schemas import KAFKA_RECORD


def kafka_options(servers: str, topic: str, *, starting_offsets: str = "earliest",
                  max_offsets_per_trigger: int | None = None,
                  min_partitions: int | None = None) -> dict[str, str]:
    """Reader options for one topic.

    ``min_partitions`` above the topic's own count splits large offset ranges over
    several tasks, so one hot Kafka partition does not bound a micro-batch.
    ``max_offsets_per_trigger`` bounds the size of a batch, for a first catch-up.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
    }
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    return options


def kafka_stream(spark: SparkSession, servers: str, topic: str, **choices) -> DataFrame:
    """One topic as a stream; ``choices`` as in ``kafka_options``. Needs Spark's Kafka package."""
    options = kafka_options(servers, topic, **choices)
    loaded = spark.readStream.format("kafka").options(**options).load()
    return loaded.select(*KAFKA_RECORD.fieldNames())


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same record shape from Parquet files appearing under ``path``."""
    reader = spark.readStream.schema(KAFKA_RECORD)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
