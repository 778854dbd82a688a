"""The derived layers: how they are laid out, and what their building moves."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, quality
from tidemark.operators.compaction import Thresholds
from tidemark.operators.fingerprint import fingerprint
from tidemark.plans import publish
from tidemark.plans.publish import Publisher
from tidemark.schemas import LANDING_DATE, ORDERS, REFUNDS
from tidemark.sources.layers import file_layout, landing_scan
from workload import stages
from workload.changes import changes, encoded, kafka_records, raw_records
from workload.queries import QUERIES

HELD = f"topic string, kafka_partition int, offset long, value string, {LANDING_DATE} date"
IMAGE = "struct<id_order string, id_client string, status_order string, amount string, created_at string, updated_at string>"
BARE = (f"before {IMAGE}, after {IMAGE}, source struct<lsn long, txId long, sequence string, ts_ms long>, "
        "op string, ts_ms long")
WRAPPED = f"payload struct<{BARE}>"


@pytest.fixture(scope="module", params=[True], ids=["odd"])
def tables(request, spark, tmp_path_factory):
    """A folder of 600 orders over 20 quarters and their items; if odd, with an order without a date and one without a key."""
    place = str(tmp_path_factory.mktemp("tables"))
    start = datetime(1995, 1, 1)
    rows = [(i, i % 7, "FOP"[i % 3], 100.0 + i, start + timedelta(days=3 * i), f"{1 + i % 5}-X") for i in range(600)]
    odd = [(600, 1, "O", 5.0, None, "2-X"), (None, 1, "F", 5.0, start, "2-X")] if request.param else []
    spark.createDataFrame(rows + odd, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{place}/orders.parquet")
    items = [(i, "RN"[i % 2], 10.0 + i) for i in range(600) for _ in range(2)]
    spark.createDataFrame(items, "l_orderkey long, l_returnflag string, l_extendedprice double").write.parquet(
        f"{place}/lineitem.parquet")
    return place


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString().replace("StructsToJsonEvaluator", "to_json")


@pytest.mark.parametrize("scattered, files", [(True, stages.FILES), (False, 1)])
def test_a_landing_holds_every_record_in_its_number_of_files(spark, tables, scattered, files):
    root = stages.landing(spark, tables, ORDERS, scattered)
    due = raw_records(spark, tables, ORDERS)
    found = landing_scan(spark, root).select(*due.columns)
    assert found.exceptAll(due).isEmpty() and due.exceptAll(found).isEmpty()
    per_date = file_layout(spark, root).groupBy(LANDING_DATE).count().where(f"{LANDING_DATE} IS NOT NULL")
    counted = [r["count"] for r in per_date.collect()]
    assert len(counted) >= 20 and max(counted) == files
    assert sum(n == files for n in counted) >= 18  # the last date has few records


def test_records_are_dealt_before_their_text_is_made(spark, tables):
    dealt = stages.by_date(stages.FILES)
    tree = plan(kafka_records(spark, tables, ORDERS, dealt))
    assert tree.count("Repartition") == 1 and tree.rindex("to_json") < tree.index("Repartition")
    placed = dealt(changes(spark, tables, ORDERS))
    assert placed.rdd.getNumPartitions() == stages.LANES * stages.FILES


def test_identities_are_read_without_the_text(spark, tables):
    raw = raw_records(spark, tables, ORDERS)
    assert "to_json" in plan(raw) and "to_json" not in plan(fingerprint(raw))
    assert "to_json" not in plan(fingerprint(raw.where(F.col("value_raw").isNotNull())))
    assert raw.where("value_raw IS NULL").count() == raw.where("length(value_raw) IS NULL").count() > 0


def test_orphans_are_found_without_a_broadcast(spark, tables):
    keys = spark.range(5).select(F.col("id").cast("string").alias("k"))
    child = spark.range(8).select(F.col("id").cast("string").alias("c"), F.col("id").cast("string").alias("ref"))
    found = quality.referential_audit(child, "ref", keys, "k", ["c"])
    assert {r.c for r in found.collect()} == {"5", "6", "7"}
    assert "Broadcast" not in plan(found, "sparkPlan")
    assert "BroadcastHashJoin" not in plan(raw_records(spark, tables, REFUNDS), "sparkPlan")


class Watched(Publisher):
    """Notes how many files a date may take, and how its rewrite is planned."""

    seen = []

    def write_runs(self, records, files, run):
        self.seen.append((files, records))
        super().write_runs(records, files, run)


@pytest.mark.parametrize("tables", [False], ids=["sound"], indirect=True)
def test_targets_below_a_file_make_no_more_tasks_than_files(spark, tables):
    root = stages.landing(spark, tables, ORDERS, scattered=True)
    listed = {r[0]: r["count"] for r in file_layout(spark, root).groupBy(LANDING_DATE).count().collect()}
    days = sorted(listed)
    limits = Thresholds(target_bytes=200, small_bytes=150, min_small_files=0, fragmentation=0)
    job = stages.publisher(spark, ORDERS, root, Watched, limits=limits)
    job.publish(days)
    files = Watched.seen[-1][0]
    assert set(files) == set(days) and all(n == listed[d] for d, n in files.items())
    assert job.published().count() == landing_scan(spark, root, days).count()


class Rewriting(Publisher):
    """Notes in how many tasks its rows are written, if no shuffle precedes."""

    seen = []

    def write_runs(self, records, files, run):
        with_plans, publish.append = publish.append, lambda writer, path: self.seen.append(
            None if "Exchange" in plan(writer._df, "sparkPlan") else writer._df.rdd.getNumPartitions()) or with_plans(writer, path)
        try:
            super().write_runs(records, files, run)
        finally:
            publish.append = with_plans


@pytest.mark.parametrize("tables", [False], ids=["sound"], indirect=True)
def test_dates_of_one_file_are_rewritten_without_a_shuffle(spark, tables):
    root = stages.landing(spark, tables, ORDERS, scattered=True)
    days = stages.landing_dates(spark, root)
    job = stages.publisher(spark, ORDERS, root, Rewriting)
    done = job.publish(days)
    assert {r.output_files for r in done.collect()} == {1}
    assert Rewriting.seen[-1] == len(days)


@pytest.fixture(scope="module")
def late_tables(spark, tmp_path_factory):
    """Orders some of whose changes cross the end of a quarter, of depths that real priorities do not have, and odd ones."""
    place = str(tmp_path_factory.mktemp("late"))
    ends = [datetime(1996, 3, 31, 22, 30), datetime(1996, 12, 31, 23, 59, 59), datetime(1997, 5, 5), None]
    rows = [(None if i == 50 else i if i % 9 else -i, i % 7, [*"FOP", None][i % 4], (-1) ** i * 37.5 * i * i, ends[i // 10 % 4],
             f"{i % 10}-X") for i in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{place}/orders.parquet")
    return place


def test_lives_are_dealt_as_one_row_per_quarter(spark, late_tables):
    seen = []
    found = kafka_records(spark, late_tables, ORDERS, lambda rows: seen.append(rows) or rows)
    due = kafka_records(spark, late_tables, ORDERS)
    assert found.exceptAll(due).isEmpty() and due.exceptAll(found).isEmpty()
    assert 200 <= seen[0].count() < 310 < due.count()
    quarters = stages.ingested_at("timestamp")
    dates = found.select(F.get_json_object(F.col("key").cast("string"), "$.id_order").alias("id"), quarters.alias("q"))
    assert dates.where("q IS NOT NULL").groupBy("id").agg(F.count_distinct("q").alias("n")).where("n > 1").count() > 10


def test_text_of_changes_is_that_of_a_json_writer(spark, late_tables):
    values = kafka_records(spark, late_tables, ORDERS).where("value IS NOT NULL").select(F.col("value").cast("string").alias("v"))
    wrapped = F.col("v").startswith('{"payload"')
    for those, schema in ((wrapped, WRAPPED), (~wrapped, BARE)):
        again = F.to_json(F.from_json("v", schema), {"ignoreNullFields": "false"})
        assert values.where(those).count() > 20 and values.where(those & (again != F.col("v"))).isEmpty()


def test_shortest_bytes(spark):
    numbers = [0, 1, -1, 127, 128, -128, -129, 255, 256, 32767, 32768, -32768, -32769, 2**40, -2**40, 2**63 - 1, -2**63, None]
    found = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", F.unbase64(encoded(F.col("n"))).alias("b")).collect()
    for r in found:
        size = None if r.n is None else next(k for k in range(1, 9) if -(1 << 8 * k - 1) <= r.n < 1 << 8 * k - 1)
        assert r.b == (None if r.n is None else r.n.to_bytes(size, "big", signed=True))


def test_changes_sent_to_several_topics_are_made_once(spark, sf):
    tree = plan(QUERIES["cdc_quarantine"](spark, sf))
    assert tree.count("Relation [o_orderkey") == 1 and "Repartition" in tree


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """History files of three dates, some events on several."""
    place = str(tmp_path_factory.mktemp("copied") / "history")
    rows = [("t", o % 3, o, f"v{o}-{d}", date(2024, 1, d)) for o in range(3000) for d in (1, 2, 3) if o % (d + 1) == 0]
    spark.createDataFrame(rows, HELD).repartition(5).write.partitionBy(LANDING_DATE).parquet(place)
    return rows, spark.read.schema(HELD).parquet(place)


@pytest.mark.parametrize("bitmaps", [history.BITMAPS, 0])
def test_later_copies_are_left_out_where_rows_lie(spark, copied, monkeypatch, bitmaps):
    rows, held = copied
    monkeypatch.setattr(history, "BITMAPS", bitmaps)
    repeated = spark.createDataFrame([("t", o % 3, o) for o in range(0, 2400)] * 2, "topic string, kafka_partition int, offset long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = history.without_repeats(held, repeated)
        assert found.columns == held.columns
        tree = plan(found, "sparkPlan")
        assert ("SortMergeJoin" in tree) == (bitmaps == 0) and "Aggregate" not in tree
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = {}
    for r in rows:
        first.setdefault(r[2], r[4])
    assert got == sorted(r for r in rows if r[2] >= 2400 or r[4] == first[r[2]])
