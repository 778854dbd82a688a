"""Mixing sources to target weights by weighted sampling without replacement.

``targets`` shares the words of the mix out among sources, ``mix`` fills each source's share:
complete passes over the source first, then a fraction drawn by Efraimidis-Spirakis. Every
document has the key -ln(u) / weight, u being a hash of its id and weight its quality; by
rising key, documents are taken until the share is full. The document at the border is
taken in part, so shares are met to the word.

No source is ever sorted as a whole. Keys fall into ranges, ``BINS`` to a doubling; sums per source and
range tell in which range the share ends, and only the documents of that range are sorted.
Whatever its weight, a document falls into any given range with a chance below 0.26 / ``BINS``,
so a source that holds a third of all rows, or one of low weights, costs no more than any other.

A null text has no words; null sources form a source, ranked last. Rows with the same id and
text are told apart by nothing and share their key; each counts as a document. A source
without words has target 0. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import fresh
from tidemark.session import written

BINS = 1024
BROADCAST_SOURCES = 100_000  # rows of one number each; beyond it the join is left to the planner
WEIGHTS = (3.0, 1.0, 2.0)


def n_words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(size: Column) -> Column:
    """In (0, 1]: 1 for plain prose, less the more characters are no letters or usual stops."""
    odd = F.coalesce(F.regexp_count("text", F.lit(r"[^\p{L}\p{M}\s.,;:'-]")), F.lit(0))
    return 1.0 / (1.0 + 4.0 * odd / F.greatest(size, F.lit(1)))


def _key(seed: int, size: Column) -> Column:
    bits = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / quality_weight(size)


def keyed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, key and bin of each document."""
    sized = docs.select("doc_id", "source", "text", n_words().alias("size"))
    sized = sized.select("doc_id", "source", "size", F.xxhash64("text").alias("tie"),
                         _key(seed, F.col("size")).alias("key"))
    place = F.floor(F.log2(F.greatest(F.col("key"), F.lit(2.0**-60))) * BINS).cast("int")
    return sized.withColumn("bin", place)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0,
            weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size), a row per source, with each one's target.

    Shares follow the weights; where one is above ``most`` times its source, it stops there
    and the others share the excess by weight. With sources sorted by size over weight, those
    that stop come first, so running sums give the common level of the others.
    """
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(whole) * F.lit(share)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after)).withColumn("rank", F.row_number().over(by))
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by("level", F.when(open_, F.col("rank"))).over(whole)
    return rows.withColumn("chosen", level).select(
        "source", "source_size",
        F.least("cap", F.coalesce(F.col("chosen") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0,
        weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, tie (hash of the text), size, source_size, target,
    epochs (complete passes), before (words of the fraction ahead of it, null if the fraction
    ends before it), rest (the fraction's words) and taken."""
    rows = written(keyed(docs, seed), "mix-keys")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(sizes, share, most, weights)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    shares = shares.withColumn("epochs", full.cast("long"))
    shares = written(shares.withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-shares")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    border = (
        bins.withColumn("upto", upto).withColumnRenamed("source", "s")
        .join(shares.select("source", "rest"), F.col("s").eqNullSafe(F.col("source")))
        .where("upto >= rest").groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("ahead"))).alias("b"))
        .select(F.col("source").alias("s"), F.col("b.bin").alias("border"), F.col("b.ahead").alias("ahead")))
    plan = shares.join(border, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.withColumnRenamed("source", "of")
    small = shares.count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    at = F.col("bin") == F.col("border")
    sorted_ = Window.partitionBy("source").orderBy("key", "doc_id", "tie", "size")
    ahead = F.col("ahead") + F.coalesce(
        F.sum("size").over(sorted_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = joined.where(at).withColumn("before", ahead)
    outside = joined.where(~at | F.col("border").isNull()).withColumn(
        "before", F.when(F.col("bin") < F.col("border"), F.lit(0).cast("long")))  # lies ahead of the end
    part = F.least("size", F.greatest(F.col("rest") - F.col("before"), F.lit(0)))
    part = F.when(F.col("bin") < F.col("border"), F.col("size")).otherwise(part)
    taken = F.col("epochs") * F.col("size") + F.coalesce(part, F.lit(0))
    return inside.unionByName(outside).select(
        "doc_id", "source", "tie", "key", "size", "source_size", "target", "epochs", "rest", "before",
        taken.cast("long").alias("taken"))


def _ranked(key: str = "key") -> Column:
    return F.struct(F.col(key).alias("key"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as often as the mix takes them, whole documents only: the one at the border
    counts if at least half of it is taken; rows alike in id, source and text go alike. The
    columns stay as they are.

    A document's place in the mix follows from its key, so only one row per source, with
    the last key taken, meets the texts; texts are not shuffled.
    """
    seed = options.get("seed", 0)
    rows = mix(docs, **options)
    half = (F.col("rest") - F.col("before")) * 2 >= F.col("size")
    chosen = (F.col("size") > 0) & F.col("before").isNotNull() & half & (F.col("rest") > 0)
    epochs, last, source, size, tie, copy = fresh(docs, "epochs", "last", "source", "size", "tie", "copy")
    plan = written(rows.groupBy("source").agg(
        F.max("epochs").alias(epochs), F.max(F.when(chosen, _ranked())).alias(last))
        .withColumnRenamed("source", source), "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES
    names = docs.columns
    sized = docs.withColumns({size: n_words(), tie: F.xxhash64("text")})
    own = F.struct(_key(seed, F.col(size)).alias("key"), F.col("doc_id").alias("doc_id"),
                   F.col(tie).alias("tie"))
    joined = sized.join(F.broadcast(plan) if small else plan,
                        F.col("source").eqNullSafe(F.col(source)))
    extra = F.when(F.coalesce(own <= F.col(last), F.lit(False)), 1).otherwise(0)
    copies = F.when(F.col(size) > 0, F.col(epochs) + extra).otherwise(0).cast("int")
    return joined.select(*names, F.explode(F.array_repeat(F.lit(True), copies)).alias(copy)).select(*names)
