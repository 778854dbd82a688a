"""Catalog tables: creation, loading, description, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def create_table(spark: SparkSession, name: str, schema: T.StructType,
                 location: str | None = None, provider: str = "parquet") -> None:
    """Create the table unless it exists. ``provider`` may name any installed table format."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_columns(schema)}) USING {provider}{place}")


def insert_rows(rows: DataFrame, name: str) -> None:
    """Append ``rows`` to the table, matching columns by position."""
    rows.write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")


def tables_in(spark: SparkSession, namespace: str) -> DataFrame:
    """Tables of the namespace; the session's own temporary views are left out."""
    listed = spark.sql(f"SHOW TABLES IN {namespace}").where("NOT isTemporary")
    return listed.select("namespace", "tableName")


def describe_namespace(spark: SparkSession, namespace: str) -> DataFrame:
    return spark.sql(f"DESCRIBE NAMESPACE {namespace}")


def write_bucketed(rows: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """Save ``rows`` bucketed and sorted by ``key``.

    Rows already partitioned by the key into ``buckets`` give one file per bucket.
    """
    (
        rows.write.mode("errorifexists")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(name)
    )


def attach_bucketed(spark: SparkSession, name: str, path: str, schema: T.StructType,
                    key: str, buckets: int) -> DataFrame:
    """The bucketed table at ``path``, registered in this session's catalog if it is not yet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_columns(schema)}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
