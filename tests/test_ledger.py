import json
from datetime import date, datetime, timedelta, timezone

import pytest

from tidemark.functions.calendar import business_date, run_id
from tidemark.operators import ledger
from tidemark.schemas import LEDGER

NOW = datetime(2024, 5, 2, 12, 0, tzinfo=timezone.utc)
DAY = date(2024, 5, 1)


def state(seq, status, minutes_ago=0, day=DAY, **facts):
    row = dict.fromkeys(LEDGER.fieldNames())
    row |= {"dataset": "orders", "partition_date": day, "seq": seq, "status": status,
            "run_id": "r", "started_at": NOW - timedelta(minutes=minutes_ago)}
    return row | facts


def verdict(spark, states, **options):
    wanted = spark.createDataFrame([("orders", DAY)], "dataset string, partition_date date")
    frame = spark.createDataFrame(states, LEDGER)
    return ledger.admission(wanted, ledger.latest(frame), NOW, **options).first().verdict


@pytest.mark.parametrize("states, expected", [
    ([], "RUN"),
    ([state(1, "COMPLETED")], "SKIP_COMPLETED"),
    ([state(1, "FAILED")], "RETRY_FAILED"),
    ([state(1, "RUNNING", 29)], "SKIP_RUNNING"),
    ([state(1, "RUNNING", 30)], "RETRY_STALE"),
    ([state(1, "RUNNING", 31)], "RETRY_STALE"),
    ([state(1, "PAUSED")], "UNKNOWN_STATUS"),
    ([state(2, "COMPLETED"), state(1, "FAILED")], "SKIP_COMPLETED"),
    ([state(1, "COMPLETED"), state(2, "FAILED")], "RETRY_FAILED"),
])
def test_admission(spark, states, expected):
    assert verdict(spark, states) == expected


def test_stale_age_can_be_set(spark):
    states = [state(1, "RUNNING", 10)]
    assert verdict(spark, states, stale_after=timedelta(minutes=5)) == "RETRY_STALE"


def test_growth_is_seen_only_when_asked_for(spark):
    states = [state(1, "COMPLETED", input_rows=10)]
    landed = spark.createDataFrame([("orders", DAY, 11)],
                                   "dataset string, partition_date date, landed_rows bigint")
    assert verdict(spark, states) == "SKIP_COMPLETED"
    assert verdict(spark, states, landed=landed) == "REPUBLISH"


def test_append_and_latest(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.read(spark, path).count() == 0
    for seq, status in ((1, "RUNNING"), (2, "COMPLETED")):
        ledger.record(spark.createDataFrame([state(seq, status)], LEDGER), path)
    assert ledger.read(spark, path).count() == 2
    assert ledger.latest(ledger.read(spark, path)).first().status == "COMPLETED"


def test_documents(spark):
    frame = spark.createDataFrame([state(1, "RUNNING")], LEDGER)
    document = json.loads(ledger.documents(frame).first().document)
    assert document["status"] == "RUNNING" and document["published_path"] is None
    assert "seq" not in document


def test_business_date_and_run_id():
    assert business_date(now=NOW) == date(2024, 5, 1)
    assert business_date("2024-02-29") == date(2024, 2, 29)
    assert business_date(DAY) == DAY
    assert run_id(NOW) == "20240502T120000000000Z"
    with pytest.raises(ValueError):
        business_date("01/02/2024")
