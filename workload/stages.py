"""Layers the queries start from, derived from the supplied tables by Spark jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.consolidate import Consolidation
from tidemark.plans.publish import Publisher
from tidemark.schemas import LANDING_DATE, Entity
from tidemark.session import scratch
from tidemark.sources.layers import file_layout, landing_scan
from tidemark.streaming.landing import project
from workload.changes import kafka_records, sent_at

FILES = 6  # files per date of a scattered landing
LANES = 16  # dates that are written at a time, of each file


def ingested_at(at="kafka_timestamp_utc"):
    """Quarter of the record's own time: gives a landing with many dates."""
    return F.date_trunc("quarter", at)


def by_date(files: int):
    """Deals changes to tasks so that each date is written as ``files`` files, whatever else a task holds."""
    def dealt(changed: DataFrame) -> DataFrame:
        quarter = ingested_at(sent_at())
        lane = F.pmod(F.coalesce(F.year(quarter) * 4 + F.quarter(quarter), F.lit(0)), F.lit(LANES))
        file = F.pmod(F.xxhash64("k", "slot"), F.lit(files)).cast("int")
        return changed.repartitionById(LANES * files, lane * files + file)

    return dealt


def topic_files(spark: SparkSession, sf_dir: str, entity: Entity, files: int = 8) -> str:
    """The topic's records as Parquet files, input of the streaming queries."""
    path = scratch(spark, f"topic-{entity.name}")
    kafka_records(spark, sf_dir, entity).repartition(files).write.parquet(path)
    return path


def landing(spark: SparkSession, sf_dir: str, entity: Entity, scattered: bool) -> str:
    """A landing with one date per quarter.

    ``scattered`` spreads each date over ``FILES`` files, as micro-batches would, which
    calls for compaction; else each date is one file.
    """
    records = project(kafka_records(spark, sf_dir, entity, by_date(FILES if scattered else 1))).withColumn(
        "ingested_at_utc", ingested_at()).withColumn(LANDING_DATE, F.to_date("ingested_at_utc"))
    path = scratch(spark, f"landing-{entity.name}")
    records.write.partitionBy(LANDING_DATE).parquet(path)
    return path


def landing_dates(spark: SparkSession, root: str) -> list:
    """Dates present in a landing."""
    days = file_layout(spark, root).select(LANDING_DATE).distinct()
    return sorted(r[0] for r in days.collect())


def publisher(spark: SparkSession, entity: Entity, root: str, kind: type[Publisher] = Publisher,
              **choices) -> Publisher:
    """A publisher of the landing at ``root`` with outputs of its own."""
    out = scratch(spark, f"published-{entity.name}")
    return kind(spark, entity.name, root, f"{out}/compacted", f"{out}/ledger", **choices)


def land_late(spark: SparkSession, sf_dir: str, entity: Entity, root: str) -> None:
    """Land the topic's records once more, an hour after those already there."""
    records = project(kafka_records(spark, sf_dir, entity, by_date(1))).withColumn("offset", F.col("offset") + 10**9)
    late = records.withColumn("ingested_at_utc", ingested_at() + F.expr("INTERVAL 1 HOUR"))
    late = late.withColumn(LANDING_DATE, F.to_date("ingested_at_utc"))
    late.write.mode("append").partitionBy(LANDING_DATE).parquet(root)


def forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """Leave a stream as if it had been killed after writing its last batch, before committing it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit())
    files.delete(hadoop.Path(folder, str(last)), False)


def land_again(spark: SparkSession, root: str) -> None:
    """Land the records of two partitions once more, a quarter after the first time."""
    later = landing_scan(spark, root).where("kafka_partition < 2").withColumn(
        LANDING_DATE, F.add_months(LANDING_DATE, 3))
    later.write.mode("append").partitionBy(LANDING_DATE).parquet(root)


@dataclass(frozen=True)
class InterruptedConsolidation(Consolidation):
    """Lets something else happen between writing its runs and naming them."""

    meanwhile: Callable[[], None] = lambda: None

    def _add(self, rows: DataFrame, name: str, schema: str) -> None:
        if name == "history-runs":
            self.meanwhile()
        super()._add(rows, name, schema)


class CrashingPublisher(Publisher):
    """Fails after writing its runs."""

    def _validate(self, *args) -> None:
        raise OSError("storage went away")


class DoublingPublisher(Publisher):
    """Writes inserts and snapshots twice."""

    def write_runs(self, records: DataFrame, files: dict, run: str) -> None:
        first = F.col("offset") % 8 == 0
        super().write_runs(records.unionByName(records.where(first)), files, run)


class LossyPublisher(Publisher):
    """Loses tombstones while rewriting, to show that validation keeps such runs hidden."""

    def write_runs(self, records: DataFrame, files: dict, run: str) -> None:
        super().write_runs(records.where(F.col("value_raw").isNotNull()), files, run)
