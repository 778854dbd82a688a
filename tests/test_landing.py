import shutil
from datetime import date

import pytest
from helpers import at, kafka_frame, landed_at
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.schemas import KAFKA_RECORD, RAW_LANDING
from tidemark.sources.layers import file_layout, landing_scan
from tidemark.sources.streams import file_stream, kafka_options, kafka_stream
from tidemark.streaming.landing import (
    catch_up,
    print_stream,
    project,
    stamp,
    start_landing,
)


@pytest.fixture
def paths(tmp_path):
    return {n: str(tmp_path / n) for n in ("topic", "landing", "checkpoint")}


def land(spark, paths, **options):
    catch_up(file_stream(spark, paths["topic"], **options), paths["landing"], paths["checkpoint"])
    return landing_scan(spark, paths["landing"])


def test_projection_renames_and_keeps_bytes(spark):
    out = stamp(project(kafka_frame(spark, 1)))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in RAW_LANDING]
    row = out.first()
    assert bytes(row.key_raw) == b"k0" and row.ingestion_date_utc == row.ingested_at_utc.date()


def test_restart_adds_nothing_and_continues(spark, paths):
    kafka_frame(spark, 20).write.parquet(paths["topic"])
    assert land(spark, paths).count() == 20
    assert land(spark, paths).count() == 20
    kafka_frame(spark, 5, start=20).write.mode("append").parquet(paths["topic"])
    landed = land(spark, paths)
    assert landed.count() == 25
    assert landed.select("topic", "kafka_partition", "offset").distinct().count() == 25


def test_bounded_micro_batches_land_everything(spark, paths):
    kafka_frame(spark, 40).repartition(8).write.parquet(paths["topic"])
    landed = land(spark, paths, max_files_per_trigger=3)
    assert landed.count() == 40
    assert landed.select("ingested_at_utc").distinct().count() == 3  # one stamp per batch


def test_processing_time_trigger(spark, paths):
    kafka_frame(spark, 4).write.parquet(paths["topic"])
    query = start_landing(file_stream(spark, paths["topic"]), paths["landing"],
                          paths["checkpoint"], interval="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert landing_scan(spark, paths["landing"]).count() == 4


def test_files_outside_the_commit_log_do_not_count(spark, paths, tmp_path):
    kafka_frame(spark, 20).write.parquet(paths["topic"])
    landed = land(spark, paths)
    day = landed.first().ingestion_date_utc
    stray = str(tmp_path / "stray")
    landed.drop("ingestion_date_utc").limit(5).coalesce(1).write.parquet(stray)
    (part,) = (tmp_path / "stray").glob("part-*.parquet")
    shutil.copy(part, tmp_path / "landing" / f"ingestion_date_utc={day}" / "part-left-over.parquet")

    assert landing_scan(spark, paths["landing"], [day]).count() == 20
    listed = [r.file_path for r in file_layout(spark, paths["landing"]).collect()]
    assert listed and not any("left-over" in p for p in listed)


def test_landing_scan_prunes_partitions(spark, paths):
    for day in (1, 2, 3):
        landed_at(kafka_frame(spark, day, start=day * 10), paths["landing"], at(day))
    out = landing_scan(spark, paths["landing"], [date(2024, 5, 2)])
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ingestion_date_utc" in plan.split("PartitionFilters")[1]
    assert len(out.inputFiles()) >= 1 and landing_scan(spark, paths["landing"]).count() == 6


def test_layout_matches_the_files(spark, paths, tmp_path):
    landed_at(kafka_frame(spark, 50).repartition(3), paths["landing"], at(1))
    landed_at(kafka_frame(spark, 5).coalesce(1), paths["landing"], at(2))
    rows = file_layout(spark, paths["landing"]).collect()
    on_disk = {p.name: p.stat().st_size for p in (tmp_path / "landing").rglob("part-*.parquet")}
    assert {r.file_path.rsplit("/", 1)[1]: r.file_bytes for r in rows} == on_disk
    assert file_layout(spark, paths["landing"], [date(2024, 5, 2)]).count() == 1


def test_a_landing_that_does_not_exist_is_an_error(spark, paths):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        landing_scan(spark, paths["landing"])
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        file_layout(spark, paths["landing"])


def test_kafka_options():
    options = kafka_options("host:9092", "t", min_partitions=64, max_offsets_per_trigger=10)
    assert options == {"kafka.bootstrap.servers": "host:9092", "subscribe": "t",
                       "startingOffsets": "earliest", "minPartitions": "64",
                       "maxOffsetsPerTrigger": "10"}


def test_kafka_source_needs_its_package(spark):
    with pytest.raises(AnalysisException, match="kafka"):
        kafka_stream(spark, "localhost:9092", "t")


def test_file_stream_has_the_record_shape(spark, paths):
    kafka_frame(spark, 1).write.parquet(paths["topic"])
    assert file_stream(spark, paths["topic"]).columns == KAFKA_RECORD.fieldNames()


def test_a_topic_can_be_printed(spark, paths):
    kafka_frame(spark, 2).write.parquet(paths["topic"])
    query = print_stream(file_stream(spark, paths["topic"]))
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == 2
