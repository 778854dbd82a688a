import os
from datetime import date
from pathlib import Path

import pytest
from helpers import at, change, image, landed_at

from tidemark import jobs
from tidemark.schemas import KAFKA_RECORD, ORDERS
from tidemark.session import object_store, rest_catalog


@pytest.fixture
def options(spark, tmp_path):
    rows = [(ORDERS.topic, 0, 0, at(), b"k", change("c", after=image("1"), lsn=1).encode()),
            (ORDERS.topic, 0, 1, at(), b"k", change("u", after=image("1", "SHIPPED"), lsn=2).encode())]
    landed_at(spark.createDataFrame(rows, KAFKA_RECORD), str(tmp_path / "landing"), at(1))
    names = ("landing", "compacted", "ledger")
    return ["--dataset", "orders", *[x for n in names for x in (f"--{n}", str(tmp_path / n))],
            "--date", "2024-05-01"]


def test_publish_preview_consolidate(spark, options, tmp_path):
    done = jobs.publish(spark, jobs.arguments(["publish", *options])).first()
    assert (done.status, done.input_rows) == ("COMPLETED", 2)
    shown = jobs.preview(spark, jobs.arguments(["preview", *options])).collect()
    assert [(r.id_order, r.status_order) for r in shown] == [("1", "SHIPPED")]
    more = ["--root", str(tmp_path / "out"), "--buckets", "2"]
    kept = jobs.consolidate(spark, jobs.arguments(["consolidate", *options, *more])).collect()
    assert [(r.id_order, r.status_order) for r in kept] == [("1", "SHIPPED")]


def test_the_whole_job_from_the_command_line(spark, options, tmp_path, capsys):
    jobs.main(["publish", *options])
    jobs.main(["preview", *options])
    shown = capsys.readouterr().out
    assert "status_order" in shown and "SHIPPED" in shown
    root = ["--root", str(tmp_path / "out"), "--buckets", "2"]
    jobs.main(["consolidate", *options, *root])
    jobs.main(["consolidate", *options, *root])
    base = [*options[:-2], *root]
    for more in (["--compact"], ["--rebuild", "--sweep"]):
        jobs.main(["maintain", *base, *more])
        assert "check" in capsys.readouterr().out
    assert jobs.maintain(spark, jobs.arguments(["maintain", *base])).collect() == []


def test_maintain_shows_what_is_wrong(spark, options, tmp_path):
    jobs.publish(spark, jobs.arguments(["publish", *options]))
    base = [*options[:-2], "--root", str(tmp_path / "out"), "--buckets", "2"]
    args = jobs.arguments(["maintain", *base])
    job = jobs._consolidation(spark, args)
    job.reprocess([date(2024, 5, 1)])  # and never folded
    left = str(tmp_path / "compacted" / "ingestion_date_utc=2024-05-01" / "run_id=LEFT")
    spark.range(1).write.parquet(left)
    for file in Path(left).glob("*.parquet"):
        os.utime(file, (0, 0))
    assert [tuple(r) for r in jobs.maintain(spark, args).orderBy("check").collect()] == [
        ("current", "missing", 1), ("runs_left", "LEFT", 1)]
    jobs.maintain(spark, jobs.arguments(["maintain", *base, "--rebuild", "--sweep"]))
    assert jobs.maintain(spark, args).collect() == [] and not Path(left).exists()


def test_preview_of_an_unpublished_date_is_empty(spark, options):
    assert jobs.preview(spark, jobs.arguments(["preview", *options])).count() == 0


def test_environment_stands_in_for_options(monkeypatch):
    for name, value in {"DATASET": "refunds", "LANDING_PATH": "/l", "COMPACTED_PATH": "/c",
                        "CONTROL_PATH": "/g", "PARTITION_DATE": "2024-02-29",
                        "RUNNING_STALE_AFTER_MINUTES": "7"}.items():
        monkeypatch.setenv(name, value)
    args = jobs.arguments(["publish"])
    assert (args.dataset, args.landing, args.ledger, args.date) == ("refunds", "/l", "/g", ["2024-02-29"])
    assert int(args.stale_minutes) == 7
    assert jobs.arguments(["publish", "--dataset", "orders"]).dataset == "orders"


def test_missing_options_are_reported(monkeypatch):
    for name in jobs.ENVIRONMENT.values():
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(SystemExit):
        jobs.arguments(["publish"])


def test_connection_settings():
    store = object_store("http://store:9000", "a", "s", tls=False)
    assert store["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert store["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    catalog = rest_catalog("lake", "http://catalog/api", "w", oauth2_server_uri="u")
    assert catalog["spark.sql.catalog.lake.type"] == "rest"
    assert catalog["spark.sql.catalog.lake.oauth2-server-uri"] == "u"
