"""Schema drift of change envelopes: paths that the stated schema does not know, or knows by another type.

Documents are read once as VARIANT, opened level by level within one stage, and counted by path and type before
anything is shuffled; the result grows with the number of different paths, not with the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import Entity

DEPTH = 6  # levels that are opened; what lies deeper counts as one value of its path
ROOT = "$"
UNREADABLE, UNKNOWN, RETYPED = "unreadable", "unknown", "retyped"

# Names by which Spark describes the kinds of a VARIANT value.
_KINDS = {T.StringType(): "STRING", T.LongType(): "BIGINT"}
_NULL = "VOID"


def stated(entity: Entity) -> dict[str, str]:
    """Path, without the wrapper, to the kind of value that the envelope schema expects."""
    out = {ROOT: "OBJECT"}

    def visit(struct: T.StructType, prefix: str) -> None:
        for f in struct.fields:
            if isinstance(f.dataType, T.StructType):
                out[prefix + f.name] = "OBJECT"
                visit(f.dataType, prefix + f.name + ".")
            else:
                out[prefix + f.name] = _KINDS[f.dataType]

    visit(entity.envelope["payload"].dataType, ROOT + ".")
    return out


def values(decoded: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Every innermost value of every document: topic, kafka_timestamp_utc, path, found. Elements of arrays share the path ``[]``;
    null ``found`` is a document that is no JSON. ``payload`` wrappers are left out of the path."""
    at = decoded.select("topic", "kafka_timestamp_utc", F.lit(ROOT).alias("path"),
                        F.try_parse_json("value_json").alias("value"))
    spark = decoded.sparkSession
    for _ in range(depth):
        each = at.withColumnRenamed("value", "whole").lateralJoin(
            spark.tvf.variant_explode_outer(F.col("whole").outer()))
        inner = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(
            F.concat("path", F.lit("."), F.col("key")))
        at = each.select("topic", "kafka_timestamp_utc",
                         F.when(F.col("pos").isNull(), F.col("path")).otherwise(inner).alias("path"),
                         F.when(F.col("pos").isNull(), F.col("whole")).otherwise(F.col("value")).alias("value"))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return at.select("topic", "kafka_timestamp_utc",
                     F.regexp_replace("path", r"^\$\.payload(?=\.|\[|$)", r"\$").alias("path"),
                     F.when(F.col("value").isNotNull(), kind).alias("found"))


def drift(decoded: DataFrame, entity: Entity, depth: int = DEPTH) -> DataFrame:
    """Values that the schema of ``entity`` does not expect: topic, path, found, expected, verdict, occurrences, first_seen.

    A null value fits everywhere. Numbers and texts are told apart: a number where text is stated is retyped.
    """
    known = stated(entity)
    paths = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    counted = values(decoded, depth).groupBy("topic", "path", "found").agg(
        F.count("*").alias("occurrences"), F.min("kafka_timestamp_utc").alias("first_seen"))
    expected = F.try_element_at(paths, F.col("path"))
    verdict = (
        F.when(F.col("found").isNull(), UNREADABLE)
        .when(F.col("expected").isNull(), UNKNOWN)
        .when((F.col("found") != F.col("expected")) & (F.col("found") != _NULL), RETYPED))
    judged = counted.withColumn("expected", expected).withColumn("verdict", verdict).where("verdict IS NOT NULL")
    return judged.select("topic", "path", "found", "expected", "verdict", "occurrences", "first_seen")
