"""Batch reads of the raw layers and of their physical layout."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import LANDING_DATE, RAW_COLUMNS, RAW_LANDING, RAW_RUN
from tidemark.session import empty

_MISSING = "PATH_NOT_FOUND"


class PublishedRunLost(RuntimeError):
    """The files of a published run are gone."""


def _read(spark: SparkSession, schema: T.StructType, *paths: str,
          base: str | None = None) -> DataFrame:
    """Parquet with a stated schema: no footer is opened to infer one."""
    reader = spark.read.schema(schema)
    if base:
        reader = reader.option("basePath", base)
    return reader.parquet(*paths)


def _on_dates(df: DataFrame, dates: Iterable[date] | None) -> DataFrame:
    return df if dates is None else df.where(F.col(LANDING_DATE).isin(list(dates)))


def landing_scan(spark: SparkSession, root: str, dates: Iterable[date] | None = None) -> DataFrame:
    """Landing records, of all dates or of some.

    The read starts at the root, so the streaming sink's commit log decides which files
    count, and leftovers of a failed micro-batch do not. The dates prune partitions. A root
    that does not exist is an error: a date may be without data, a landing may not.
    """
    return _on_dates(_read(spark, RAW_LANDING, root), dates)


def landings_scan(spark: SparkSession, roots: Iterable[str],
                  dates: Iterable[date] | None = None) -> DataFrame:
    """Records of several landings of one dataset, each read from its own root."""
    parts = [landing_scan(spark, root, dates) for root in roots]
    return reduce(DataFrame.unionByName, parts)


def run_path(compacted: str, day: date, run: str) -> str:
    """Directory of one run of one date."""
    return f"{compacted}/{LANDING_DATE}={day}/run_id={run}"


def run_scan(spark: SparkSession, compacted: str, paths: list[str]) -> DataFrame:
    """Records of the named run directories only; other runs are not even listed.

    A directory that is gone is an error that names it: what is left would look complete.
    """
    if not paths:
        return empty(spark, RAW_RUN)
    try:
        return _read(spark, RAW_RUN, *paths, base=compacted)
    except AnalysisException as error:
        if error.getCondition() != _MISSING:
            raise
        raise PublishedRunLost(str(error)) from error


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that exist: one status call each, for as many as there are dates."""
    out, hadoop = [], spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop(path)
        if place.getFileSystem(conf).exists(place):
            out.append(path)
    return out


_LAYOUT = T.StructType([
    T.StructField(LANDING_DATE, T.DateType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_bytes", T.LongType()),
])


def file_layout(spark: SparkSession, root: str, dates: Iterable[date] | None = None,
                paths: list[str] | None = None) -> DataFrame:
    """One row per Parquet file: date, path and size. Contents are not read.

    ``paths`` narrows the listing to some directories below ``root``.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    files = reader.option("basePath", root).load(paths) if paths else reader.load(root)
    if LANDING_DATE not in files.columns:  # nothing but an empty directory
        return empty(spark, _LAYOUT)
    return _on_dates(files, dates).select(
        F.col(LANDING_DATE).cast("date").alias(LANDING_DATE),
        F.col("path").alias("file_path"),
        F.col("length").alias("file_bytes"),
    )


def files_of(records: DataFrame) -> DataFrame:
    """Files behind a Parquet read, with size and row count, from the read's metadata."""
    return (
        records.select("_metadata.file_path", "_metadata.file_size")
        .groupBy("file_path")
        .agg(F.max("file_size").alias("file_bytes"), F.count("*").alias("file_rows"))
    )


def raw_columns(df: DataFrame) -> DataFrame:
    return df.select(*RAW_COLUMNS)
