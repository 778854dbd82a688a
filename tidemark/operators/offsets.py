"""Which offsets a layer holds, one bit each, and where the log is interrupted.

Offsets are gathered in bitmaps of 2**15, inside each task first: what travels is a bit per offset,
not a row, and a topic partition that holds most of the log is spread over as many groups as it has
bitmaps. Runs of offsets are read off the bitmaps; only those that are interrupted are looked
at bit by bit, and runs of neighbouring bitmaps meet by a row per bitmap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

GROUP = ("topic", "kafka_partition")
BITS = 15  # positions of a bitmap of Spark's, as a power of two

# Hexadecimal digits and their four bits, lowest first. Letters stand in for the digits, so that a replaced
# one is not replaced again.
_DIGITS, _STAND_INS = "0123456789ABCDEF", "ghijklmnopqrstuv"
_NIBBLES = {letter: f"{i:04b}"[::-1] for i, letter in enumerate(_STAND_INS)}


def presence(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A bitmap of offsets per ``by``, topic partition and bucket of 2**15 offsets, with the number
    of rows and the first and last offset."""
    places = records.select(
        *by, *GROUP, "offset", F.shiftright("offset", BITS).alias("bucket"),
        F.col("offset").bitwiseAND(F.lit((1 << BITS) - 1)).alias("place"))
    return places.groupBy(*by, *GROUP, "bucket").agg(
        F.count("*").alias("rows"), F.min("offset").alias("from_offset"), F.max("offset").alias("to_offset"),
        F.bitmap_construct_agg("place").alias("bits"))


def coverage(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, different offsets, first and last offset per ``by`` and topic partition. More rows than
    offsets mean that some offset is there more than once."""
    return bitmaps.groupBy(*by, *GROUP).agg(
        F.sum("rows").alias("rows"), F.sum(F.bitmap_count("bits")).alias("offsets"),
        F.min("from_offset").alias("from_offset"), F.max("to_offset").alias("to_offset"))


def _bit_text(bits: Column) -> Column:
    """Bits as characters, in the order of their offsets."""
    nibbles = F.regexp_replace(F.hex(bits), "(.)(.)", "$2$1")  # the lower half of a byte comes first
    text = F.translate(nibbles, _DIGITS, _STAND_INS)
    for letter, four in _NIBBLES.items():
        text = F.replace(text, F.lit(letter), F.lit(four))
    return text


def runs(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unbroken runs of offsets within a bitmap: ``by``, topic partition, bucket, from_offset, to_offset."""
    keys = [*by, *GROUP, "bucket"]
    whole = F.bitmap_count("bits") == F.col("to_offset") - F.col("from_offset") + 1
    unbroken = bitmaps.where(whole).select(*keys, "from_offset", "to_offset")
    pieces = bitmaps.where(~whole).select(
        *keys, F.posexplode(F.regexp_extract_all(_bit_text(F.col("bits")), F.lit("0+|1+"), F.lit(0))).alias("n", "run"))
    before = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("run")).over(before), F.lit(0)) + F.shiftleft("bucket", BITS)
    placed = pieces.withColumn("from_offset", start).where(F.col("run").startswith("1"))
    return unbroken.unionByName(placed.select(
        *keys, "from_offset", (F.col("from_offset") + F.length("run") - 1).alias("to_offset")))


def gaps(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stretches of offsets that are missing between the first and the last of a topic partition:
    ``by``, topic partition, from_offset, to_offset, missing. Repeated offsets change nothing."""
    return gaps_of(written(presence(records, by), "presence"), by)


def gaps_of(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from bitmaps, which are read twice. One task per topic partition orders a narrow row per bitmap."""
    keys = [*by, *GROUP, "bucket"]
    bounds = bitmaps.select(*keys, "from_offset")
    order = Window.partitionBy(*by, *GROUP).orderBy("bucket")
    edges = bounds.select(*keys, F.lead("from_offset").over(order).alias("next_bucket_from"))
    own = Window.partitionBy(*keys).orderBy("from_offset")
    after = runs(bitmaps, by).withColumn("next_from", F.lead("from_offset").over(own))
    inside = after.where(F.col("next_from").isNotNull())
    last = after.where(F.col("next_from").isNull()).drop("next_from").join(edges, keys).withColumnRenamed(
        "next_bucket_from", "next_from")
    missing = F.col("next_from") - F.col("to_offset") - 1
    found = inside.unionByName(last.select(*inside.columns)).withColumn("missing", missing).where("missing > 0")
    return found.select(*by, *GROUP, (F.col("to_offset") + 1).alias("from_offset"),
                        (F.col("next_from") - 1).alias("to_offset"), "missing")
