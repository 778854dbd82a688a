"""Publication ledger: append-only states, the newest one counts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import COMPLETED, FAILED, LEDGER, RUNNING
from tidemark.session import append, empty

# Admission verdicts.
RUN = "RUN"
RETRY_FAILED = "RETRY_FAILED"
RETRY_STALE = "RETRY_STALE"
SKIP_COMPLETED = "SKIP_COMPLETED"
SKIP_RUNNING = "SKIP_RUNNING"
REPUBLISH = "REPUBLISH"
UNKNOWN_STATUS = "UNKNOWN_STATUS"
ADMITTED = (RUN, RETRY_FAILED, RETRY_STALE, REPUBLISH)

# --- fixed value: age after which a running state counts as abandoned ---
STALE_AFTER = timedelta(minutes=30)
# --- end of fixed value ---

KEYS = ("dataset", "partition_date")
# A total order of the states of a date: of two runs that reach the same number, the one
# started later counts.
_ORDER = ("seq", "started_at", "run_id")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every state ever recorded; empty before the first one."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, LEDGER)


def record(states: DataFrame, path: str) -> None:
    """Record states. One file per call appears whole or not at all."""
    ordered = states.select(*LEDGER.fieldNames())
    append(ordered.coalesce(1).write, path)


def latest(states: DataFrame) -> DataFrame:
    """The state in force per dataset and date."""
    rest = [c for c in states.columns if c not in KEYS]
    order = F.struct(*[c for c in _ORDER if c in rest])
    newest = F.max_by(F.struct(*rest), order).alias("newest")
    return states.groupBy(*KEYS).agg(newest).select(*KEYS, "newest.*")


def visible(states: DataFrame) -> DataFrame:
    """What readers see per dataset and date: the newest completed state that names a path.

    Runs that are under way, failed or found nothing leave the one before them visible.
    """
    done = (F.col("status") == COMPLETED) & F.col("published_path").isNotNull()
    return latest(states.where(done))


def admission(wanted: DataFrame, in_force: DataFrame, now: datetime,
              stale_after: timedelta = STALE_AFTER, landed: DataFrame | None = None) -> DataFrame:
    """``wanted`` datasets and dates with a verdict each, for a whole backfill at once.

    ``landed`` (dataset, partition_date, landed_rows) is optional: with it, a completed
    date whose landing has grown since is published again.
    """
    state = in_force.select(*KEYS, "status", "seq", "started_at", "input_rows")
    rows = wanted.select(*KEYS).join(state, list(KEYS), "left")
    done = F.lit(SKIP_COMPLETED)
    if landed is not None:
        rows = rows.join(landed.select(*KEYS, "landed_rows"), list(KEYS), "left")
        grown = F.col("landed_rows") > F.col("input_rows")
        done = F.when(grown, REPUBLISH).otherwise(SKIP_COMPLETED)
    cutoff = F.lit(now - stale_after)
    verdict = (
        F.when(F.col("seq").isNull(), RUN)
        .when(F.col("status") == COMPLETED, done)
        .when(F.col("status") == FAILED, RETRY_FAILED)
        .when((F.col("status") == RUNNING) & (F.col("started_at") > cutoff), SKIP_RUNNING)
        .when(F.col("status") == RUNNING, RETRY_STALE)
        .otherwise(UNKNOWN_STATUS)
    )
    return rows.select(*KEYS, "status", F.coalesce("seq", F.lit(0)).alias("seq"),
                       verdict.alias("verdict"))


def documents(in_force: DataFrame) -> DataFrame:
    """The state in force as one JSON document per dataset and date."""
    fields = [c for c in in_force.columns if c != "seq"]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return in_force.select(*KEYS, body.alias("document"))
