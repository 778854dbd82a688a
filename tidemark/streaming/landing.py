"""Kafka records to the immutable, date-partitioned raw landing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schemas import LANDING_DATE
from tidemark.sources.layers import existing


def project(records: DataFrame) -> DataFrame:
    """Landing names for the record columns; key and value stay unparsed bytes."""
    return records.select(
        "topic",
        F.col("partition").alias("kafka_partition"),
        "offset",
        F.col("timestamp").alias("kafka_timestamp_utc"),
        F.col("key").alias("key_raw"),
        F.col("value").alias("value_raw"),
    )


def stamp(projected: DataFrame) -> DataFrame:
    """Add the ingestion time, one value per write, and its UTC date.

    The time is that of the write and nobody else's: what is published in place is bounded
    by it, so a record that arrives later must never carry an earlier one.
    """
    return projected.withColumn("ingested_at_utc", F.current_timestamp()).withColumn(
        LANDING_DATE, F.to_date("ingested_at_utc")
    )


def start_landing(records: DataFrame, path: str, checkpoint: str, *,
                  available_now: bool = False, interval: str | None = None) -> StreamingQuery:
    """Start the query that appends ``records`` to the landing at ``path``.

    Without a trigger, micro-batches follow one another at once. ``interval`` spaces
    them out and so yields fewer, larger files. ``available_now`` takes what is there
    and stops. The checkpoint carries progress over restarts; a record is landed once.
    """
    writer = (
        stamp(project(records))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(LANDING_DATE)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start(path)


def catch_up(records: DataFrame, path: str, checkpoint: str) -> None:
    """Land everything available now and return when it is committed."""
    query = start_landing(records, path, checkpoint, available_now=True)
    query.awaitTermination()


def land_batch(records: DataFrame, path: str) -> None:
    """Append records outside the stream, to a landing of their own, for backfills.

    Readers of a landing that a stream writes see only what the stream's commit log lists,
    so such a root is refused. ``Publisher(backfills=...)`` reads both.
    """
    if existing(records.sparkSession, [f"{path}/_spark_metadata"]):
        raise ValueError(f"{path} belongs to a stream; land backfills below a root of their own")
    stamp(project(records)).write.mode("append").partitionBy(LANDING_DATE).parquet(path)


def print_stream(records: DataFrame) -> StreamingQuery:
    """Print the records available now to the console, to look at a topic by hand."""
    return (
        records.writeStream.format("console")
        .option("truncate", "false")
        .trigger(availableNow=True)
        .start()
    )
