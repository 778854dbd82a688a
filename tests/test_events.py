from datetime import datetime
from decimal import Decimal

import pytest
from helpers import change, image, raw_frame
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.schemas import ENTITIES, ORDERS


def rows(df):
    return df.orderBy("offset").collect()


def test_tombstones_are_dropped_before_parsing(spark):
    raw = raw_frame(spark, [change("c", after=image()), None])
    assert [r.offset for r in rows(ev.decode(raw))] == [0]


@pytest.mark.parametrize("wrapped", [True, False])
def test_both_envelope_shapes_give_the_same_event(spark, wrapped):
    raw = raw_frame(spark, [change("u", before=image(), after=image(status="SHIPPED", cents=-5),
                                   lsn=9, wrapped=wrapped)])
    (event,) = rows(ev.events(raw, ORDERS))
    assert event.asDict() == {
        "id_order": "1", "id_client": "c1", "status_order": "SHIPPED", "amount": Decimal("-0.05"),
        "created_at": datetime(2024, 5, 1, 10), "updated_at": datetime(2024, 5, 1, 10),
        "cdc_operation": "u", "source_lsn": 9, "source_tx_id": 7, "source_sequence": '[null,"9"]',
        "source_ts_ms": 4, "cdc_ts_ms": 5, "topic": ORDERS.topic, "kafka_partition": 0,
        "offset": 0, "kafka_timestamp_utc": datetime(2024, 5, 1)}


def test_schema_section_beside_the_payload_is_ignored(spark):
    value = change("c", after=image()).replace('{"payload"', '{"schema":{"type":"struct"},"payload"')
    (event,) = rows(ev.events(raw_frame(spark, [value]), ORDERS))
    assert event.id_order == "1"


def test_delete_takes_the_image_before(spark):
    raw = raw_frame(spark, [change("d", before=image(status="DELIVERED"))])
    (event,) = rows(ev.events(raw, ORDERS))
    assert (event.cdc_operation, event.status_order) == ("d", "DELIVERED")


def test_delete_with_only_the_key_keeps_nulls(spark):
    bare = dict.fromkeys(image(), None) | {"id_order": "1"}
    (event,) = rows(ev.events(raw_frame(spark, [change("d", before=bare)]), ORDERS))
    assert (event.id_order, event.amount, event.status_order) == ("1", None, None)


@pytest.mark.parametrize("written, read", [
    ("2024-05-01T10:00:00Z", datetime(2024, 5, 1, 10)),
    ("2024-05-01T10:00:00.123456Z", datetime(2024, 5, 1, 10, 0, 0, 123456)),
    ("2024-05-01T10:00:00+00:00", datetime(2024, 5, 1, 10)),
    ("2024-05-01T22:30:00-03:00", datetime(2024, 5, 2, 1, 30))])
def test_zoned_timestamps(spark, written, read):
    raw = raw_frame(spark, [change("c", after=image(created=written))])
    (event,) = rows(ev.events(raw, ORDERS))
    assert event.created_at == read


def test_bad_records_are_set_aside_with_a_reason_and_none_is_lost(spark):
    values = [
        change("c", after=image()),
        "not json",
        '{"k": 1}',
        change("c", after=image(id_order=None)),
        change("c", after=image(amount="***")),
        change("c", after=image(cents=10**12)),
        change("c", after=image(created="yesterday noon")),
        change("u", after=image(updated="2024-13-01T00:00:00Z")),
    ]
    parsed = ev.parse(ev.decode(raw_frame(spark, values)), ORDERS)
    reasons = {r.offset: r.reject_reason for r in rows(ev.quarantine(parsed, ORDERS))}
    assert reasons == {1: "unreadable", 2: "unreadable", 3: "missing_key", 4: "bad_amount",
                       5: "bad_amount", 6: "bad_timestamp", 7: "bad_timestamp"}
    assert [r.offset for r in rows(ev.normalize(parsed, ORDERS))] == [0]


def test_carried_columns_survive(spark):
    raw = raw_frame(spark, [change("c", after=image())])
    out = ev.events(raw, ORDERS, carry=("ingestion_date_utc",))
    assert out.columns == [*ORDERS.event_columns, "ingestion_date_utc"]


def test_events_have_the_declared_schema(spark):
    for entity in ENTITIES.values():
        out = ev.events(raw_frame(spark, []), entity)
        assert [(f.name, f.dataType) for f in out.schema] \
            == [(f.name, f.dataType) for f in entity.event_schema]


def test_json_is_parsed_once_and_the_null_filter_reaches_the_scan(spark, tmp_path):
    raw_frame(spark, [change("c", after=image())]).write.parquet(str(tmp_path / "raw"))
    out = ev.events(spark.read.parquet(str(tmp_path / "raw")), ORDERS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
    assert plan.count("unbase64") == 1
    assert "PushedFilters: [IsNotNull(value_raw)]" in plan
    assert "key_raw" not in plan.split("ReadSchema")[1]
    assert "Exchange" not in plan


def test_operation_profile(spark):
    raw = raw_frame(spark, [change("c", after=image()), change("c", after=image("2")),
                            change("d", before=image())])
    out = ev.operation_profile(ev.events(raw, ORDERS))
    assert {r.cdc_operation: r.events for r in out.collect()} == {"c": 2, "d": 1}
    assert out.select(F.sum("events")).first()[0] == 3
