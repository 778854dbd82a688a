"""Small hand-made records for tests."""

from __future__ import annotations

import base64
import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.schemas import KAFKA_RECORD, LANDING_DATE, ORDERS, RAW_LANDING
from tidemark.streaming.landing import project


def encoded(unscaled: int) -> str:
    size = max(1, (unscaled.bit_length() + 8) // 8)
    raw = unscaled.to_bytes(size, "big", signed=True)
    while len(raw) > 1 and raw[0] in (0, 255) and (raw[0] == 255) == (raw[1] >= 128):
        raw = raw[1:]
    return base64.b64encode(raw).decode()


def image(key="1", status="CREATED", cents=1000, created="2024-05-01T10:00:00Z",
          updated="2024-05-01T10:00:00Z", **changes):
    row = {"id_order": key, "id_client": "c" + key, "status_order": status,
           "amount": encoded(cents), "created_at": created, "updated_at": updated}
    return row | changes


def change(op, before=None, after=None, lsn=1, wrapped=True):
    body = {"before": before, "after": after, "op": op, "ts_ms": 5,
            "source": {"lsn": lsn, "txId": 7, "sequence": f'[null,"{lsn}"]', "ts_ms": 4}}
    return json.dumps({"payload": body} if wrapped else body)


def at(day=1, hour=0, minute=0):
    return datetime(2024, 5, day, hour, minute, tzinfo=timezone.utc)


def raw_frame(spark, values, topic=ORDERS.topic, partition=0, day=1):
    """Landing rows with running offsets; a value of None is a tombstone."""
    rows = []
    for offset, value in enumerate(values):
        data = value.encode() if isinstance(value, str) else value
        rows.append((topic, partition, offset, at(day), b"k", data, at(day), at(day).date()))
    return spark.createDataFrame(rows, RAW_LANDING)


def kafka_frame(spark, count, partition=0, start=0, topic=ORDERS.topic):
    rows = [(topic, partition, o, at(), f"k{o}".encode(), change("c", after=image(str(o)), lsn=o).encode())
            for o in range(start, start + count)]
    return spark.createDataFrame(rows, KAFKA_RECORD)


def landed_at(records, root, when):
    """A landing as it was left by a write at ``when``."""
    stamped = project(records).withColumn("ingested_at_utc", F.lit(when)).withColumn(
        LANDING_DATE, F.to_date("ingested_at_utc"))
    stamped.write.mode("append").partitionBy(LANDING_DATE).parquet(root)


EVENT_FIELDS = ORDERS.event_columns


def event(key, lsn, offset, status="CREATED", op="u"):
    row = dict.fromkeys(EVENT_FIELDS)
    row |= {"id_order": key, "source_lsn": lsn, "offset": offset, "status_order": status,
            "cdc_operation": op, "topic": ORDERS.topic, "kafka_partition": 0}
    return tuple(row[f] for f in EVENT_FIELDS)


def event_frame(spark, rows):
    return spark.createDataFrame(rows, ORDERS.event_schema)
