"""What crashed or rejected publications left behind, and its removal.

Runs are written first and named last, so a run without a name is never read; it only takes space. The files are
listed by Spark and met with all runs the ledger ever named; the driver holds nothing but the paths to remove.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import utc_now
from tidemark.operators import ledger
from tidemark.plans.publish import Publisher
from tidemark.schemas import LANDING_DATE, RUNNING
from tidemark.session import empty
from tidemark.sources.layers import existing, run_path

# --- fixed value: age from which an unnamed run counts as left behind ---
LEFT_AFTER = timedelta(days=1)
# --- end of fixed value ---

_RUNS = f"{LANDING_DATE} date, run_id string, files bigint, bytes bigint, newest timestamp"


def written_runs(spark: SparkSession, compacted: str) -> DataFrame:
    """Runs that have files, named or not: date, run, files, bytes, time of the newest file."""
    if not existing(spark, [compacted]):
        return empty(spark, spark.createDataFrame([], _RUNS).schema)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(compacted))
    day, run = (F.regexp_extract("path", f"/{name}=([^/]+)/", 1) for name in (LANDING_DATE, "run_id"))
    named = files.select(day.try_cast("date").alias(LANDING_DATE), run.alias("run_id"), "length", "modificationTime")
    return named.where((F.col("run_id") != "") & F.col(LANDING_DATE).isNotNull()).groupBy(LANDING_DATE, "run_id").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def orphan_runs(publisher: Publisher, older_than: timedelta = LEFT_AFTER, now: datetime | None = None) -> DataFrame:
    """Runs that no state of the ledger ever published, whose newest file is older than ``older_than``.

    A run under way that began within that time may still be named and is left out, whatever its files' age; runs
    that were published once stay, as a reader may hold them.
    """
    cutoff = F.lit((now or utc_now()) - older_than)
    states = ledger.read(publisher.spark, publisher.ledger_path).where(F.col("dataset") == publisher.dataset)
    in_use = F.col("published_path").isNotNull() | (
        (F.col("status") == RUNNING) & (F.col("started_at") > cutoff))
    used = states.where(in_use).select(F.col("partition_date").alias(LANDING_DATE), "run_id").distinct()
    runs = written_runs(publisher.spark, publisher.compacted).where(F.col("newest") <= cutoff)
    return runs.join(used, [LANDING_DATE, "run_id"], "left_anti")


def remove(publisher: Publisher, runs: Iterable) -> list[str]:
    """Remove the folders of ``runs`` (rows of ``orphan_runs``) and return their paths."""
    spark, out = publisher.spark, []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in runs:
        path = run_path(publisher.compacted, r[LANDING_DATE], r.run_id)
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        out.append(path)
    return out
