"""Current state: the latest event per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import DELETE_OP, Entity

# Later log position wins; among copies of one change the later offset wins.
ORDERING = ("source_lsn", "offset")


def latest(events: DataFrame, entity: Entity) -> DataFrame:
    """One row per key. Each task reduces its own rows first, so a hot key sends one
    row per task over the network; the result does not depend on row order."""
    rest = [c for c in entity.event_columns if c != entity.key]
    newest = F.max_by(F.struct(*rest), F.struct(*ORDERING)).alias("newest")
    return events.groupBy(entity.key).agg(newest).select(entity.key, "newest.*")


def active(current: DataFrame) -> DataFrame:
    """Current rows whose key still exists at the source."""
    return current.where(F.col("cdc_operation") != DELETE_OP)


def fold(current: DataFrame, batch: DataFrame, entity: Entity,
         buckets: int | None = None) -> DataFrame:
    """Current state after a batch of events, in any order and however often applied.

    The batch is reduced to one row per key and meets the stored rows on the key; the
    newer row stays. Where ``current`` is stored in ``buckets`` by its key, it is read in
    place: the reduced batch moves to the buckets, the stored rows do not, and every task
    ends up with the rows of exactly one bucket.
    """
    reduced = latest(batch, entity)
    if buckets:
        reduced = reduced.repartition(buckets, entity.key)
    return merge(current, reduced, entity)


def merge(current: DataFrame, reduced: DataFrame, entity: Entity) -> DataFrame:
    """The newer row per key of two tables that hold each key once. Tables bucketed alike by
    the key are joined where they lie."""
    key = entity.key
    rest = [c for c in entity.event_columns if c != key]
    new = reduced.select(
        F.col(key).alias("new_key"), F.struct(*ORDERING).alias("new_order"),
        F.struct(*rest).alias("new_row"))
    old = current.select(key, F.struct(*ORDERING).alias("old_order"),
                         F.struct(*rest).alias("old_row"))
    joined = old.join(new, F.col(key) == F.col("new_key"), "full_outer")
    newer = F.col("old_order").isNull() | (F.col("new_order") > F.col("old_order"))
    return joined.select(
        F.coalesce(key, "new_key").alias(key),
        F.when(newer, F.col("new_row")).otherwise(F.col("old_row")).alias("row"),
    ).select(key, "row.*")
