"""Identity fingerprints: proof that two sets hold the same records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import IDENTITY

GROUP = ("topic", "kafka_partition")
METRICS = ("row_count", "min_offset", "max_offset", "hash_sum", "payload_hash_sum")

_LOW_BITS = 22


def exact_sum(value: Column) -> Column:
    """Sum of 64-bit values as decimal(38,0).

    The value is summed in three bit ranges, each a plain bigint sum that stays in range
    up to 2^41 rows per group. Summing decimals row by row gives the same number but
    works on objects instead of machine words.
    """
    mask = (1 << _LOW_BITS) - 1
    high = F.sum(F.shiftright(value, 2 * _LOW_BITS))
    middle = F.sum(F.shiftright(value, _LOW_BITS).bitwiseAND(F.lit(mask)))
    low = F.sum(value.bitwiseAND(F.lit(mask)))

    def weighted(part: Column, bits: int) -> Column:
        return part.cast("decimal(20,0)") * F.lit(1 << bits).cast("decimal(14,0)")

    total = weighted(high, 2 * _LOW_BITS) + weighted(middle, _LOW_BITS) + weighted(low, 0)
    return total.cast("decimal(38,0)")


def fingerprint(raw: DataFrame, by: Sequence[str] = (), payload: bool = False,
                ingested: bool = False) -> DataFrame:
    """Row count, offset range and identity hash sum per ``by`` and topic partition.

    Only the identity columns are read. ``payload`` adds ``payload_hash_sum`` over key and
    value bytes, at the price of reading them; ``ingested`` adds the newest ingestion time,
    which is not part of the proof. Tasks send one row per group.
    """
    metrics = [
        F.count("*").alias("row_count"),
        F.min("offset").alias("min_offset"),
        F.max("offset").alias("max_offset"),
        exact_sum(F.col("identity_hash")).alias("hash_sum"),
    ]
    columns = [*by, *IDENTITY, F.xxhash64(*IDENTITY).alias("identity_hash")]
    if payload:
        columns.append(F.xxhash64("key_raw", "value_raw").alias("payload_hash"))
        metrics.append(exact_sum(F.col("payload_hash")).alias("payload_hash_sum"))
    if ingested:
        columns.append("ingested_at_utc")
        metrics.append(F.max("ingested_at_utc").alias("last_ingested_at"))
    return raw.select(*columns).groupBy(*by, *GROUP).agg(*metrics)


def comparison(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both fingerprints side by side per group, with ``equal`` telling whether they agree.

    A group that one side lacks is not equal.
    """
    keys = [*by, *GROUP]
    metrics = [m for m in METRICS if m in left.columns]

    def sided(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, *[F.col(m).alias(f"{side}_{m}") for m in metrics])

    equal = F.lit(True)
    for m in metrics:
        equal = equal & F.col(f"input_{m}").eqNullSafe(F.col(f"output_{m}"))
    both = sided(left, "input").join(sided(right, "output"), keys, "full_outer")
    return both.withColumn("equal", equal)


def difference(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Groups whose fingerprints differ or exist on one side only; none means equal."""
    return comparison(left, right, by).where(~F.col("equal")).drop("equal")


def duplicates(raw: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Identities that occur more than once, with their count."""
    return raw.groupBy(*identity).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
