"""When to rewrite a date's files, and into how many."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import DO_COMPACTION, LANDING_DATE, NO_NEED

_MB = 1024 * 1024


# --- fixed values: operating thresholds ---
@dataclass(frozen=True)
class Thresholds:
    target_bytes: int = 128 * _MB
    small_bytes: int = 96 * _MB
    min_small_files: int = 5
    fragmentation: float = 4
# --- end of fixed values ---


def policy(layout: DataFrame, by: Sequence[str] = (LANDING_DATE,),
           limits: Thresholds = Thresholds()) -> DataFrame:
    """Decision per group of ``layout`` rows, for every group in one pass."""
    needed = F.expr(f"(input_bytes + {limits.target_bytes - 1}L) div {limits.target_bytes}L")
    ratio = F.col("input_files") / F.col("expected_files")
    compact = (F.col("small_files") >= limits.min_small_files) & (
        F.col("fragmentation_ratio") >= limits.fragmentation
    )
    return (
        layout.groupBy(*by)
        .agg(
            F.count("*").alias("input_files"),
            F.sum("file_bytes").alias("input_bytes"),
            F.count_if(F.col("file_bytes") < limits.small_bytes).alias("small_files"),
        )
        .withColumn("expected_files", F.greatest(F.lit(1).cast("bigint"), needed))
        .withColumn("fragmentation_ratio", ratio)
        .withColumn("operation", F.when(compact, DO_COMPACTION).otherwise(NO_NEED))
    )
