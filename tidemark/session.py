"""Session settings the jobs rely on, and the shared folder for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.types import StructType

# Settings that change results or plans. All are runtime settings, so they can
# be applied to a session somebody else built.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",  # sums that leave their range fail instead of wrapping
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Unlike the older format, this one carries statistics, so scans skip row groups by time.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Change text shrinks to about half of what the default codec makes of it.
    "spark.sql.parquet.compression.codec": "zstd",
    # A task that meets few dates keeps a file open for each and need not sort whole records by date.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
    # HotSpot leaves larger methods to its interpreter; operators that would be one run one by one instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Parts of one task each stay tasks of their own in a union, and bucketed parts are not taken for one bucketed table.
    "spark.sql.unionOutputPartitioning": "false",
}

# --- fixed value: Spark's own pattern of settings to hide in plans and logs, and one word more ---
REDACTION = r"(?i)secret|password|token|access[.]?key" + "|credential"
# --- end of fixed value ---


def object_store(endpoint: str, access_key: str, secret_key: str, *, tls: bool = True) -> dict[str, str]:
    """Settings for an S3-compatible store that is addressed by path."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": "true",
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(tls).lower(),
    }


def rest_catalog(name: str, uri: str, warehouse: str, **more: str) -> dict[str, str]:
    """Settings of a REST table catalog; ``more`` holds further keys of the catalog, such as
    ``credential`` or ``scope``, with ``_`` for ``-``. Needs the table format's package."""
    prefix = f"spark.sql.catalog.{name}"
    return {
        prefix: "org.apache.iceberg.spark.SparkCatalog",
        f"{prefix}.type": "rest",
        f"{prefix}.uri": uri,
        f"{prefix}.warehouse": warehouse,
    } | {f"{prefix}.{key.replace('_', '-')}": value for key, value in more.items()}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def builder(app: str, *settings: dict[str, str]) -> SparkSession.Builder:
    """A session builder with the settings that must be known before start-up."""
    out = SparkSession.builder.appName(app).config("spark.redaction.regex", REDACTION)
    for group in (RUNTIME, *settings):
        for key, value in group.items():
            out = out.config(key, value)
    return out


def packed_session(spark: SparkSession, bytes_per_task: int) -> SparkSession:
    """A session like ``spark`` whose scans give each task files of up to ``bytes_per_task``, largest
    first, whatever their number and however many cores are free. Larger files are split."""
    out = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            out.conf.set(key, value)
    out.conf.set("spark.sql.files.maxPartitionBytes", f"{bytes_per_task}b")
    out.conf.set("spark.sql.files.openCostInBytes", "0b")
    out.conf.set("spark.sql.files.minPartitionNum", "1")
    return out


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unique path under the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(writer: DataFrameWriter, path: str) -> None:
    """Append Parquet below ``path``, safe beside other appends to the same path.

    Hadoop's committer stages all jobs of one attempt number in one folder, and the first to end moves and
    removes what it finds there. A number of its own keeps each append apart; only that folder is removed.
    """
    attempt = uuid.uuid4().int & 0x7FFFFFFF
    staged = f"{path}/_temporary/{attempt}"
    (
        writer.mode("append").option("mapreduce.job.application.attempt.id", attempt)
        .option("mapreduce.fileoutputcommitter.cleanup.skipped", "true").parquet(path)
    )
    spark = SparkSession.active()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, known as such when planning, so joins and unions with it vanish."""
    return spark.createDataFrame([], schema).limit(0)
