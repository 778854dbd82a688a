import shutil
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from helpers import at, kafka_frame, landed_at
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.operators.compaction import Thresholds
from tidemark.plans.publish import PublicationRejected, Publisher
from tidemark.schemas import LEDGER, RAW_COLUMNS
from tidemark.session import packed_session
from tidemark.sources.layers import PublishedRunLost, file_layout, landings_scan, run_scan
from tidemark.sources.streams import file_stream
from tidemark.streaming.landing import catch_up, land_batch

D1, D2, D3 = date(2024, 5, 1), date(2024, 5, 2), date(2024, 5, 3)


class Losing(Publisher):
    def write_runs(self, records, files, run):
        super().write_runs(records.where("offset <> 3"), files, run)


class Doubling(Publisher):
    def write_runs(self, records, files, run):
        super().write_runs(records.unionByName(records.where("offset = 3")), files, run)


class Crashing(Publisher):
    """Fails between writing the run and recording it."""

    def _validate(self, *args):
        raise OSError("storage went away")


@pytest.fixture
def place(spark, tmp_path):
    """A landing whose first date is fragmented and whose second is not."""
    root = str(tmp_path / "landing")
    landed_at(kafka_frame(spark, 60).repartition(6), root, at(1))
    landed_at(kafka_frame(spark, 10, start=60).coalesce(1), root, at(2))

    def make(kind=Publisher, **options):
        return kind(spark, "orders", root, str(tmp_path / "compacted"), str(tmp_path / "ledger"),
                    **options)

    make.root = root
    return make


def states(df):
    return {r.partition_date: r for r in df.collect()}


def offsets(df):
    return sorted(r.offset for r in df.select("offset").collect())


def test_dates_are_compacted_or_published_in_place(spark, place):
    job = place()
    done = states(job.publish([D1, D2, D3]))
    assert {d: (r.status, r.operation, r.input_rows, r.output_rows, r.input_files, r.output_files)
            for d, r in done.items()} == {
        D1: ("COMPLETED", "DO_COMPACTION", 60, 60, 6, 1),
        D2: ("COMPLETED", "NO_NEED", 10, 10, 1, 1),
        D3: ("COMPLETED", None, 0, 0, 0, 0)}
    assert done[D1].validation.asDict() == {
        "method": "kafka_identity_fingerprint",
        "identity_columns": ["topic", "kafka_partition", "offset"], "result": "PASSED"}
    assert done[D1].published_path.endswith(f"ingestion_date_utc=2024-05-01/run_id={done[D1].run_id}")
    assert done[D3].published_path is None and done[D3].validation is None
    assert done[D1].output_bytes > 0 and done[D1].finished_at >= done[D1].started_at
    assert job.published().columns == list(RAW_COLUMNS)
    assert offsets(job.published()) == list(range(70))
    assert offsets(job.published([D2])) == list(range(60, 70))
    assert job.published([D3]).count() == 0


def test_default_date_is_the_day_before(spark, place):
    job = place()
    done = states(job.publish(now=datetime(2024, 5, 3, 0, 30, tzinfo=timezone.utc)))
    assert list(done) == [D2]


def test_a_completed_date_is_left_alone(spark, place):
    job = place()
    first = states(job.publish([D1]))[D1]
    assert states(job.publish([D1]))[D1] == first


@pytest.mark.parametrize("kind", [Losing, Doubling])
def test_a_run_that_differs_is_never_visible(spark, place, kind):
    job = place(kind)
    with pytest.raises(PublicationRejected, match="2024-05-01"):
        job.publish([D1, D2])
    now = states(job.in_force())
    assert (now[D1].status, now[D1].validation.result, now[D1].published_path) \
        == ("FAILED", "FAILED", None)
    assert now[D1].error and now[D1].finished_at
    assert now[D2].status == "COMPLETED"
    assert offsets(job.published()) == list(range(60, 70))
    # the next attempt gets a run of its own and succeeds
    again = states(place().publish([D1]))[D1]
    assert again.status == "COMPLETED" and again.run_id != now[D1].run_id
    assert offsets(job.published()) == list(range(70))


def test_a_crash_before_the_ledger_row_leaves_nothing_visible(spark, place, tmp_path):
    job = place(Crashing)
    with pytest.raises(OSError):
        job.publish([D1])
    assert list((tmp_path / "compacted").rglob("part-*.parquet"))
    assert job.published().count() == 0
    failed = states(job.in_force())[D1]
    assert failed.status == "FAILED" and "storage went away" in failed.error
    place().publish([D1])
    assert offsets(job.published()) == list(range(60))


def test_running_blocks_until_stale(spark, place):
    job = place()
    now = datetime(2024, 5, 4, 12, tzinfo=timezone.utc)
    row = dict.fromkeys(LEDGER.fieldNames()) | {
        "dataset": "orders", "partition_date": D1, "seq": 1, "run_id": "r", "status": "RUNNING",
        "started_at": now - timedelta(minutes=10)}
    ledger.record(spark.createDataFrame([row], LEDGER), job.ledger_path)
    assert states(job.publish([D1], now))[D1].status == "RUNNING"
    assert states(job.publish([D1], now + timedelta(minutes=21)))[D1].status == "COMPLETED"


def test_an_unknown_status_stops_the_job(spark, place):
    job = place()
    row = dict.fromkeys(LEDGER.fieldNames()) | {
        "dataset": "orders", "partition_date": D1, "seq": 1, "status": "ODD"}
    ledger.record(spark.createDataFrame([row], LEDGER), job.ledger_path)
    with pytest.raises(ValueError, match="ODD"):
        job.publish([D1])


def test_records_landed_later_stay_hidden_until_republished(spark, place):
    job = place()
    job.publish([D1, D2])
    landed_at(kafka_frame(spark, 3, start=70).coalesce(1), place.root, at(2, 23))
    assert offsets(job.published([D2])) == list(range(60, 70))
    job.publish([D2])
    assert offsets(job.published([D2])) == list(range(60, 70))
    done = states(place(republish_grown=True).publish([D1, D2]))
    assert done[D2].input_rows == 13
    assert offsets(job.published([D2])) == list(range(60, 73))


def test_materialized_dates_are_runs(spark, place):
    job = place(materialize=True, payload=True)
    done = states(job.publish([D2]))
    assert done[D2].operation == "NO_NEED" and "run_id=" in done[D2].published_path
    assert offsets(job.published()) == list(range(60, 70))


def test_a_run_that_is_gone_is_an_error_that_names_it(spark, place):
    job = place()
    done = states(job.publish([D1]))
    missing = job.compacted + "/ingestion_date_utc=2024-05-09/run_id=none"
    with pytest.raises(PublishedRunLost, match="2024-05-09"):
        run_scan(spark, job.compacted, [missing, done[D1].published_path])
    shutil.move(done[D1].published_path.removeprefix("file:"), job.compacted + "-elsewhere")
    with pytest.raises(PublishedRunLost, match="2024-05-01"):
        job.published()


def test_a_date_published_in_place_that_is_gone_is_an_error_that_names_it(spark, place):
    job = place()
    job.publish([D1, D2])
    shutil.move(f"{place.root}/ingestion_date_utc=2024-05-02", job.compacted + "-elsewhere")
    with pytest.raises(PublishedRunLost, match="2024-05-02"):
        job.published()
    assert offsets(job.published([D1])) == list(range(60))


@pytest.mark.parametrize("day, lost", [(D1, "compacted/ingestion_date_utc=2024-05-01/run_id=*"),
                                       (D2, "landing/ingestion_date_utc=2024-05-02")])
def test_lost_files_are_found_by_counting(spark, place, tmp_path, day, lost):
    landed_at(kafka_frame(spark, 9, start=70).coalesce(1), place.root, at(2))
    job = place(materialize=False, limits=Thresholds(target_bytes=4000, small_bytes=10**6, min_small_files=3,
                                                fragmentation=0))
    job.publish([D1, D2])
    assert offsets(job.published(verify=True)) == list(range(79))
    files = sorted(tmp_path.glob(f"{lost}/part-*.parquet"))
    assert len(files) > 1
    files[0].rename(tmp_path / "elsewhere")
    with pytest.raises(PublishedRunLost, match=f"^{day}: [0-9]+ records published, [0-9]+ found$"):
        job.published(verify=True)


def test_a_failed_republication_leaves_the_good_run_visible(spark, place):
    job = place()
    job.publish([D1, D2])
    landed_at(kafka_frame(spark, 3, start=70).coalesce(1), place.root, at(1, 23))
    landed_at(kafka_frame(spark, 3, start=80).coalesce(1), place.root, at(2, 23))
    with pytest.raises(PublicationRejected):
        place(Losing, republish_grown=True).publish([D1, D2])
    assert states(job.in_force())[D1].status == "FAILED"
    assert offsets(job.published([D1])) == list(range(60))
    place(republish_grown=True).publish([D1])
    assert offsets(job.published([D1])) == [*range(60), 70, 71, 72]


def test_states_with_one_number_are_ordered_by_their_start(spark, place):
    row = dict.fromkeys(LEDGER.fieldNames()) | {"dataset": "d", "partition_date": D1, "seq": 3}
    rows = [row | {"run_id": "a", "started_at": at(1, 2), "status": "COMPLETED"},
            row | {"run_id": "b", "started_at": at(1, 1), "status": "FAILED"}]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, LEDGER).coalesce(1)
        assert ledger.latest(frame).first().run_id == "a"


def test_a_missing_landing_is_an_error_not_an_empty_date(spark, tmp_path):
    job = Publisher(spark, "orders", str(tmp_path / "typo"), str(tmp_path / "c"), str(tmp_path / "l"))
    with pytest.raises(AnalysisException, match="typo"):
        job.publish([D1])
    assert states(job.in_force())[D1].status == "FAILED"


def test_a_stream_and_its_backfill_are_published_together(spark, tmp_path):
    topic, root, more = (str(tmp_path / n) for n in ("topic", "landing", "backfill"))
    kafka_frame(spark, 20).write.parquet(topic)
    catch_up(file_stream(spark, topic), root, str(tmp_path / "checkpoint"))
    with pytest.raises(ValueError, match="stream"):
        land_batch(kafka_frame(spark, 7, start=20), root)
    land_batch(kafka_frame(spark, 7, start=20), more)
    job = Publisher(spark, "orders", root, str(tmp_path / "c"), str(tmp_path / "l"), backfills=(more,))
    days = {r[0] for r in landings_scan(spark, job.landings).select("ingestion_date_utc").distinct().collect()}
    job.publish(days)
    assert offsets(job.published()) == list(range(27))


def test_one_bad_date_leaves_the_others_published(spark, place):
    landed_at(kafka_frame(spark, 5, start=90).repartition(2), place.root, at(3))
    bad = next(Path(place.root).glob("ingestion_date_utc=2024-05-03/part-*.parquet"))
    bad.write_bytes(b"not parquet")
    job = place()
    with pytest.raises(Exception):
        job.publish([D1, D2, D3])
    done = states(job.in_force())
    assert {d: r.status for d, r in done.items()} == {D1: "COMPLETED", D2: "COMPLETED", D3: "FAILED"}
    assert offsets(job.published([D1, D2])) == list(range(70))


def test_nothing_published_yet(spark, place):
    assert place().published().count() == 0
    assert place().published([D1]).columns == list(RAW_COLUMNS)


def test_several_files_per_date_without_a_shuffle(spark, place):
    job = place()
    records = job.spark.read.parquet(place.root)
    job.write_runs(records.withColumn("ingestion_date_utc", F.col("ingestion_date_utc").cast("date")),
                   {D1: 3, D2: None}, "r1")
    layout = file_layout(spark, job.compacted)
    assert {r[0]: r[1] for r in layout.groupBy("ingestion_date_utc").count().collect()} \
        == {D1: 3, D2: 1}


def test_files_of_unequal_sizes_become_files_of_about_one_target(spark, tmp_path):
    """Eight files of about 60 kB and forty of a few records: dealt by number, one output would hold most."""
    root, target = str(tmp_path / "landing"), 150_000
    noise = F.unhex(F.concat(*[F.sha2(F.concat(F.col("offset").cast("string"), F.lit(f"-{i}")), 512) for i in range(8)]))
    large, small = kafka_frame(spark, 960).repartition(8), kafka_frame(spark, 80, start=960).repartition(40)
    for part in (large, small):
        landed_at(part.withColumn("value", noise), root, at(1))
    sizes = [r.file_bytes for r in file_layout(spark, root).collect()]
    assert len(sizes) == 48 and max(sizes) > 8 * min(sizes)
    job = Publisher(spark, "orders", root, str(tmp_path / "compacted"), str(tmp_path / "ledger"),
                    limits=Thresholds(target_bytes=target, small_bytes=target))
    state = states(job.publish([D1]))[D1]
    written_sizes = [r.file_bytes for r in file_layout(spark, job.compacted).collect()]
    expected = -(-sum(sizes) // target)
    assert (state.status, state.operation, state.output_rows) == ("COMPLETED", "DO_COMPACTION", 1040)
    assert max(written_sizes) <= 1.5 * target and expected // 2 < len(written_sizes) <= 2 * expected
    assert offsets(job.published()) == list(range(1040))
    plan = landings_scan(packed_session(spark, target), [root], [D1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_date_with_files_but_no_rows_publishes_nothing(spark, place):
    day = f"{place.root}/ingestion_date_utc=2024-05-03"
    spark.createDataFrame([], spark.read.parquet(place.root).drop("ingestion_date_utc").schema) \
        .write.parquet(day)
    job = place()
    done = states(job.publish([D3]))[D3]
    assert (done.status, done.input_rows, done.published_path) == ("COMPLETED", 0, None)
    assert job.published().count() == 0


def test_a_retry_at_the_same_stated_time_gets_its_own_run(spark, place):
    now = datetime(2024, 5, 3, tzinfo=timezone.utc)
    with pytest.raises(PublicationRejected):
        place(Losing).publish([D1], now)
    done = states(place().publish([D1], now))[D1]
    assert (done.status, done.output_rows) == ("COMPLETED", 60)
