"""Record shapes shared by every job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: names and formats that readers and writers must agree on ---
IDENTITY = ("topic", "kafka_partition", "offset")
LANDING_DATE = "ingestion_date_utc"
TOPIC_PREFIX = "cdc_debezium.public."

RUNNING = "RUNNING"
COMPLETED = "COMPLETED"
FAILED = "FAILED"
PASSED = "PASSED"
DO_COMPACTION = "DO_COMPACTION"
NO_NEED = "NO_NEED"
VALIDATION_METHOD = "kafka_identity_fingerprint"

DELETE_OP = "d"
OPERATIONS = ("c", "r", "u", "d")

AMOUNT_PRECISION = 10
AMOUNT_SCALE = 2
# --- end of fixed values ---


STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
BINARY, TIMESTAMP, DATE = T.BinaryType(), T.TimestampType(), T.DateType()
AMOUNT = T.DecimalType(AMOUNT_PRECISION, AMOUNT_SCALE)


def _struct(columns: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


KAFKA_RECORD = _struct({
    "topic": STRING,
    "partition": INT,
    "offset": LONG,
    "timestamp": TIMESTAMP,
    "key": BINARY,
    "value": BINARY,
})

RAW_LANDING = _struct({
    "topic": STRING,
    "kafka_partition": INT,
    "offset": LONG,
    "kafka_timestamp_utc": TIMESTAMP,
    "key_raw": BINARY,
    "value_raw": BINARY,
    "ingested_at_utc": TIMESTAMP,
    "ingestion_date_utc": DATE,
})

# Columns of a published record: the landing columns, whichever layer holds them.
RAW_COLUMNS = tuple(RAW_LANDING.fieldNames())

RAW_RUN = T.StructType(RAW_LANDING.fields + [T.StructField("run_id", STRING)])

EVENT_METADATA = {
    "cdc_operation": STRING,
    "source_lsn": LONG,
    "source_tx_id": LONG,
    "source_sequence": STRING,
    "source_ts_ms": LONG,
    "cdc_ts_ms": LONG,
    "topic": STRING,
    "kafka_partition": INT,
    "offset": LONG,
    "kafka_timestamp_utc": TIMESTAMP,
}

# --- fixed values: the facts a publication records ---
LEDGER = _struct({
    "dataset": STRING,
    "partition_date": DATE,
    "seq": LONG,
    "run_id": STRING,
    "started_at": TIMESTAMP,
    "status": STRING,
    "operation": STRING,
    "published_path": STRING,
    "published_through": TIMESTAMP,
    "finished_at": TIMESTAMP,
    "input_bytes": LONG,
    "output_bytes": LONG,
    "input_files": LONG,
    "output_files": LONG,
    "input_rows": LONG,
    "output_rows": LONG,
    "validation": _struct({
        "method": STRING,
        "identity_columns": T.ArrayType(STRING),
        "result": STRING,
    }),
    "error": STRING,
})
# --- end of fixed values ---


@dataclass(frozen=True)
class Entity:
    """A captured source table: its columns and the rules its rows obey."""

    name: str
    key: str
    ref: str
    status: str
    states: tuple[str, ...]
    zero_allowed: bool
    parent: str | None = None

    @property
    def topic(self) -> str:
        return TOPIC_PREFIX + self.name

    @property
    def fields(self) -> tuple[str, ...]:
        return (self.key, self.ref, self.status, "amount", "created_at", "updated_at")

    @property
    def event_columns(self) -> tuple[str, ...]:
        return tuple(self.event_schema.fieldNames())

    @property
    def image(self) -> T.StructType:
        """Row image inside the envelope; every business field travels as text."""
        return _struct(dict.fromkeys(self.fields, STRING))

    @property
    def envelope(self) -> T.StructType:
        """One schema that reads a change with or without its ``payload`` wrapper."""
        change = {
            "before": self.image,
            "after": self.image,
            "source": _struct({"lsn": LONG, "txId": LONG, "sequence": STRING, "ts_ms": LONG}),
            "op": STRING,
            "ts_ms": LONG,
        }
        return _struct({"payload": _struct(change)} | change)

    @property
    def event_schema(self) -> T.StructType:
        """Schema of a normalised event."""
        business = dict.fromkeys(self.fields, STRING) | {
            "amount": AMOUNT,
            "created_at": TIMESTAMP,
            "updated_at": TIMESTAMP,
        }
        return _struct(business | EVENT_METADATA)


# --- fixed values: captured tables and their state domains ---
ORDERS = Entity(
    name="orders",
    key="id_order",
    ref="id_client",
    status="status_order",
    states=("CREATED", "CONFIRMED", "SHIPPED", "DELIVERED", "CANCELLED"),
    zero_allowed=True,
)
PAYMENTS = Entity(
    name="payments",
    key="id_payment",
    ref="id_order",
    status="status_payment",
    states=("PENDING", "AUTHORIZED", "CAPTURED", "DECLINED", "CANCELLED"),
    zero_allowed=False,
    parent="orders",
)
REFUNDS = Entity(
    name="refunds",
    key="id_refund",
    ref="id_payment",
    status="status_refund",
    states=("PENDING", "APPROVED", "COMPLETED", "FAILED", "CANCELLED"),
    zero_allowed=False,
    parent="payments",
)
# --- end of fixed values ---

ENTITIES = {e.name: e for e in (ORDERS, PAYMENTS, REFUNDS)}
