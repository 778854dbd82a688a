"""Versions of a row over the log: how long each was valid, and which one another event met.

Positions are log sequence numbers. Rows of a key are ordered by windows; a key with more than ``HOT`` rows is
divided into stretches of the log first, whose borders are joined by a row per stretch, so that no task orders
a large part of all rows. There are at most rows / ``HOT`` such keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import DELETE_OP, Entity
from tidemark.session import written

HOT = 1_000_000


def _with_stretch(rows: DataFrame, key: str, at: str, hot: int) -> tuple[DataFrame, bool]:
    """``rows`` with the ``stretch`` of the log they belong to, and whether any key has several."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot_key")).agg(
        F.count("*").alias("held"), F.min(at).alias("low"), F.max(at).alias("high"))
    large = written(counts.where(F.col("held") > hot), "hot-keys")
    if large.isEmpty():
        return rows.withColumn("stretch", F.lit(0).cast("bigint")), False
    parts = F.ceil(F.col("held") / F.lit(hot)) * 2
    cast = "decimal(38,0)"  # the product may leave the range of a bigint
    part = ((F.col(at) - F.col("low")).cast("decimal(20,0)") * parts.cast("decimal(12,0)")).cast(cast) / (
        F.col("high") - F.col("low") + 1).cast("decimal(20,0)")
    marked = rows.join(large, F.col(key) == F.col("hot_key"), "left")
    stretch = F.coalesce(F.floor(part).cast("bigint"), F.lit(0).cast("bigint"))
    return marked.withColumn("stretch", stretch).drop("hot_key", "held", "low", "high"), True


def versions(history: DataFrame, entity: Entity, hot: int = HOT) -> DataFrame:
    """Events with ``valid_to_lsn``, the position of the next change of the key (none for the last one). Of copies of
    one change the one of the latest offset stays. A version holds from its position up to, not including, that of the next."""
    key, at = entity.key, "source_lsn"
    rows, divided = _with_stretch(history.select(*entity.event_columns), key, at, hot)
    order = Window.partitionBy(key, "stretch").orderBy(at, "offset")
    ahead = rows.withColumn("valid_to_lsn", F.lead(at).over(order)).where(
        F.col("valid_to_lsn").isNull() | (F.col("valid_to_lsn") != F.col(at)))
    if divided:
        firsts = rows.groupBy(key, "stretch").agg(F.min(at).alias("first"))
        following = Window.partitionBy(key).orderBy("stretch")
        edges = firsts.select(key, "stretch", F.lead("first").over(following).alias("edge"))
        ahead = ahead.join(edges, [key, "stretch"]).withColumn(
            "valid_to_lsn", F.coalesce("valid_to_lsn", "edge")).drop("edge")
    return ahead.drop("stretch")


def at_position(valid: DataFrame, lsn: int) -> DataFrame:
    """The table as it stood when the log had reached ``lsn``: versions valid there, deleted rows left out."""
    begun = F.col("source_lsn") <= lsn
    lasts = F.col("valid_to_lsn").isNull() | (F.col("valid_to_lsn") > lsn)
    return valid.where(begun & lasts & (F.col("cdc_operation") != DELETE_OP))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, carry: Sequence[str],
          hot: int = HOT) -> DataFrame:
    """``left`` with the columns ``carry`` of the last row of ``right`` with the same ``key`` at or before
    its own position ``at``; null where there is none. Among right rows of one position the largest ``tie`` counts.

    Both sides are written once, as they are read several times, and laid into one order, in which each left row takes
    what was seen last, so every row moves once, however many right rows a left row could meet.
    """
    seen = F.struct(*[F.col(c).alias(c) for c in carry])
    none = F.lit(None)
    rights = right.select(F.col(key).alias("k"), F.col(at).alias("p"), F.lit(0).alias("side"), F.col(tie).alias("t"),
                          seen.alias("seen"), none.alias("row"))
    kind = rights.schema["seen"].dataType
    own = F.struct(*[F.col(c).alias(c) for c in left.columns])
    lefts = left.select(F.col(key).alias("k"), F.col(at).alias("p"), F.lit(1).alias("side"),
                        none.cast(rights.schema["t"].dataType).alias("t"), none.cast(kind).alias("seen"), own.alias("row"))
    row_kind = lefts.schema["row"].dataType
    both = written(rights.withColumn("row", none.cast(row_kind)).unionByName(lefts), "as-of")
    rows, divided = _with_stretch(both, "k", "p", hot)
    order = Window.partitionBy("k", "stretch").orderBy("p", "side", "t")
    last = F.last("seen", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("found", last).where("side = 1")
    if divided:
        ends = rows.groupBy("k", "stretch").agg(
            F.max_by("seen", F.when(F.col("side") == 0, F.struct("p", "t"))).alias("final"))
        # Every stretch of a left row needs what the stretches before it ended with.
        before = Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("k", "stretch", F.last("final", ignorenulls=True).over(before).alias("carried")).where(
            "carried IS NOT NULL")
        met = met.join(carried, ["k", "stretch"], "left").withColumn("found", F.coalesce("found", "carried"))
    absent = F.col("k").isNull()  # a null key meets nothing
    found: list[Column] = [F.when(~absent, F.col(f"found.{c}")).alias(c) for c in carry]
    return met.select("row.*", *found)
