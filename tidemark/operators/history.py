"""Event history: every normalised event once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.offsets import BITS
from tidemark.operators.quality import domain_rules
from tidemark.schemas import IDENTITY, LANDING_DATE, Entity
from tidemark.session import written

MEASURES = ("topic string, kafka_partition int, cdc_operation string, events bigint, violations array<bigint>, "
            "keys binary, latency binary")
BITMAPS = 16_384  # of 4 KB each: the most that are sent to every executor
SKETCH_BITS = 12  # standard error of distinct counts about 1.6 %


def distinct_events(events: DataFrame, by: Sequence[str] = IDENTITY) -> DataFrame:
    """Events deduplicated on their record identity. Of several copies the one of the earliest
    landing date stays, and among those the one that sorts first, whatever order they are
    read in."""
    rest = [c for c in events.columns if c not in by]
    order = sorted(rest, key=lambda c: c != LANDING_DATE)
    first = F.min(F.struct(*order)).alias("first")
    return events.groupBy(*by).agg(first).select(*[
        F.col(c) if c in by else F.col(f"first.{c}") for c in events.columns])


def measures(events: DataFrame, entity: Entity) -> DataFrame:
    """What is worth knowing of events, per landing date, topic partition and operation: their number, how often each
    domain rule is broken, and mergeable sketches of their keys and of their way to the log."""
    rules = domain_rules(entity)
    latency = F.unix_millis("kafka_timestamp_utc") - F.col("source_ts_ms")
    counted = events.groupBy(LANDING_DATE, "topic", "kafka_partition", "cdc_operation").agg(
        F.count("*").alias("events"),
        F.array(*[F.count_if(broken) for broken in rules.values()]).alias("violations"),
        F.hll_sketch_agg(entity.key, SKETCH_BITS).alias("keys"),
        F.kll_sketch_agg_bigint(latency).alias("latency"))
    return counted


def negative(measured: DataFrame) -> DataFrame:
    """Counts of ``measured`` taken off; sketches cannot forget and are left out."""
    return measured.withColumn("events", -F.col("events")).withColumn(
        "violations", F.transform("violations", lambda n: -n)).withColumn(
        "keys", F.lit(None).cast("binary")).withColumn("latency", F.lit(None).cast("binary"))


def profile(measured: DataFrame) -> DataFrame:
    """Events per topic and operation."""
    counted = measured.groupBy("topic", "cdc_operation").agg(F.sum("events").alias("events"))
    return counted.where("events > 0")


def violations(measured: DataFrame, entity: Entity) -> DataFrame:
    """Violations per domain rule."""
    rules = list(domain_rules(entity))
    sums = measured.agg(*[F.coalesce(F.sum(F.get("violations", F.lit(i))), F.lit(0)).alias(name)
                          for i, name in enumerate(rules)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])))


def estimates(measured: DataFrame) -> DataFrame:
    """Per topic: different keys (standard error 1.04 / 2**(bits / 2)), and the milliseconds within which half, and 99 of 100,
    events reached the log."""
    merged = measured.groupBy("topic").agg(
        F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_bigint("latency").alias("latency"))
    return merged.select(
        "topic", F.hll_sketch_estimate("keys").alias("distinct_keys"),
        F.kll_sketch_get_quantile_bigint("latency", F.lit(0.5)).alias("median_ms"),
        F.kll_sketch_get_quantile_bigint("latency", F.lit(0.99)).alias("p99_ms"))


def once_per_date(batch: DataFrame, arrived: DataFrame) -> DataFrame:
    """``batch`` with each identity once per landing date. ``arrived`` holds the identities and
    dates of the raw records behind it, which are cheaper to count.

    Repeats are the exception, so they are looked for first, by identity alone. Without
    any, the batch passes untouched and unshuffled.
    """
    by = [LANDING_DATE, *IDENTITY]
    counted = arrived.groupBy(*by).agg(F.count("*").alias("copies"))
    repeated = written(counted.where(F.col("copies") > 1).select(*by), "repeated")
    if repeated.isEmpty():
        return batch
    untouched = batch.join(repeated, by, "left_anti")
    again = batch.join(repeated, by, "left_semi")
    return untouched.unionByName(distinct_events(again, by))


def without_repeats(history: DataFrame, repeated: DataFrame) -> DataFrame:
    """``history``, a read of files, in which the identities of ``repeated`` keep their copy of the earliest landing date only.

    Copies are compared by identity, date and place in their files. What is to be left out is a bit per row of a file,
    so that whole rows stay where they are read, unless there are more than ``BITMAPS`` bitmaps.
    """
    once = repeated.select(*IDENTITY).distinct()
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = written(history.select(path.alias("path")).distinct().select(
        "path", F.monotonically_increasing_id().alias("file")), "files")
    placed = history.select(*IDENTITY, LANDING_DATE, path.alias("path"), row.alias("row")).join(
        F.broadcast(files), "path").drop("path")  # a row per file
    copies = placed.join(once, list(IDENTITY), "left_semi")
    order = Window.partitionBy(*IDENTITY).orderBy(LANDING_DATE, "file", "row")
    later = copies.withColumn("n", F.row_number().over(order)).where("n > 1").select(
        "file", F.shiftright("row", BITS).alias("block"), F.col("row").bitwiseAND(F.lit((1 << BITS) - 1)).alias("place"))
    dropped = later.repartition("file", "block").groupBy("file", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
    dropped = written(dropped.join(F.broadcast(files), "file").drop("file"), "later-copies")
    few = dropped.limit(BITMAPS + 1).count() <= BITMAPS
    place = F.col("row").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    kept = F.col("bits").isNull() | (F.getbit(byte, place.bitwiseAND(F.lit(7))) == 0)
    marked = history.select("*", path.alias("path"), row.alias("row"), F.shiftright(row, BITS).alias("block")).join(
        F.broadcast(dropped) if few else dropped, ["path", "block"], "left")
    return marked.where(kept).select(*history.columns)
