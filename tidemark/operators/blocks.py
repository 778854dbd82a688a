"""Fingerprints of blocks of offsets, in a tree: where two layers differ, not only whether.

A leaf covers 2**``bits`` offsets of a topic partition; a node above covers 2**``fan`` of the nodes below and
holds their sums, so a tree is made from its leaves alone and layers are summed, not read again. Two trees are
compared from the top: only the children of differing nodes are met. The rows behind differing leaves are
opened by offset ranges that reach the scan, so files and row groups of equal blocks are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fingerprint import GROUP, exact_sum
from tidemark.operators.quality import reconcile
from tidemark.schemas import IDENTITY
from tidemark.session import written

BITS, FAN, LEVELS = 12, 4, 4  # leaves of 4096 offsets, 16 children a node, nodes of up to 2**24 offsets
RANGES = 64  # pushed into one scan at most

NODE = ("level", *GROUP, "block")
SUMS = ("row_count", "hash_sum")


def leaves(records: DataFrame, bits: int = BITS) -> DataFrame:
    """Row count and identity hash sum per block of offsets; tasks send a row per block they meet."""
    hashed = records.select(*GROUP, F.shiftright("offset", bits).alias("block"),
                            F.xxhash64(*IDENTITY).alias("identity_hash"))
    return hashed.groupBy(*GROUP, "block").agg(
        F.count("*").alias("row_count"), exact_sum(F.col("identity_hash")).alias("hash_sum"))


def tree(lowest: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """All levels over the leaves: level (0: leaves), topic partition, block, sums. Written once, then summed
    level by level."""
    at = written(lowest.select(F.lit(0).alias("level"), *GROUP, "block", *SUMS), "leaves")
    parts = [at]
    for level in range(1, levels):
        total = F.sum("hash_sum").cast("decimal(38,0)")
        at = at.groupBy(*GROUP, F.shiftright("block", fan).alias("block")).agg(
            F.sum("row_count").alias("row_count"), total.alias("hash_sum")).select(
            F.lit(level).alias("level"), *GROUP, "block", *SUMS)
        parts.append(at)
    return reduce(DataFrame.unionByName, parts)


def keep(nodes: DataFrame, path: str) -> None:
    """Store a tree beside its layer, level by level."""
    nodes.write.mode("errorifexists").partitionBy("level").parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    schema = ("topic string, kafka_partition int, block bigint, row_count bigint, hash_sum decimal(38,0), level int")
    return spark.read.schema(schema).parquet(path)


def merged(trees: Sequence[DataFrame]) -> DataFrame:
    """The tree of several layers together, such as of one layer's dates."""
    return reduce(DataFrame.unionByName, trees).groupBy(*NODE).agg(
        F.sum("row_count").alias("row_count"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"))


def differing(left: DataFrame, right: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """Leaves in which two trees differ, with the row counts of both (0 where a side has none)."""
    def met(level: int, parents: DataFrame | None) -> DataFrame:
        def side(nodes: DataFrame, name: str) -> DataFrame:
            own = nodes.where(F.col("level") == level)
            if parents is not None:
                above = parents.select(*GROUP, F.col("block").alias("parent"))
                own = own.withColumn("parent", F.shiftright("block", fan)).join(
                    above, [*GROUP, "parent"], "left_semi")
            return own.select(*GROUP, "block", F.col("row_count").alias(f"{name}_rows"),
                              F.col("hash_sum").alias(f"{name}_sum"))

        both = side(left, "input").join(side(right, "output"), [*GROUP, "block"], "full_outer")
        unlike = ~F.col("input_rows").eqNullSafe(F.col("output_rows")) | ~F.col("input_sum").eqNullSafe(
            F.col("output_sum"))
        return written(both.where(unlike).na.fill(0, ["input_rows", "output_rows"]), "differing")

    found = None
    for level in reversed(range(levels)):
        found = met(level, found)
        if found.isEmpty():
            break
    return found.select(*GROUP, "block", "input_rows", "output_rows")


def bounds(blocks: DataFrame, bits: int = BITS) -> DataFrame:
    """``blocks`` with the offsets they cover."""
    start = F.shiftleft("block", bits)
    return blocks.withColumn("from_offset", start).withColumn("to_offset", start + ((1 << bits) - 1))


def _ranges(blocks: DataFrame, bits: int, limit: int) -> Column | None:
    """A condition on offsets that holds all ``blocks``, of at most ``limit`` ranges; none if even one
    range per topic partition would be more."""
    narrow = written(blocks.select(*GROUP, "block"), "blocks")
    for wider in range(0, 63 - bits, 4):
        places = narrow.select(*GROUP, F.shiftright("block", wider).alias("block")).distinct().limit(limit + 1).collect()
        if len(places) <= limit:
            width = 1 << (bits + wider)
            return reduce(Column.__or__, [
                (F.col("topic") == p.topic) & (F.col("kafka_partition") == p.kafka_partition)
                & (F.col("offset") >= p.block * width) & (F.col("offset") < (p.block + 1) * width)
                for p in places], F.lit(False))
    return None


def opened(records: DataFrame, blocks: DataFrame, bits: int = BITS, limit: int = RANGES) -> DataFrame:
    """Records within the blocks. At most ``limit`` ranges, widened as needed, reach the scan; the blocks
    themselves then choose among what it reads."""
    within = _ranges(blocks, bits, limit)
    near = records if within is None else records.where(within)
    wanted = blocks.select(*GROUP, F.col("block").alias("wanted"))
    on = [near[c] == wanted[c] for c in GROUP] + [F.shiftright(near["offset"], bits) == wanted["wanted"]]
    return near.join(wanted, on, "left_semi")


def reconcile_blocks(left: DataFrame, right: DataFrame, blocks: DataFrame, bits: int = BITS) -> DataFrame:
    """``quality.reconcile`` of what the differing blocks hold; equal blocks are neither read nor shuffled."""
    return reconcile(opened(left, blocks, bits), opened(right, blocks, bits))
