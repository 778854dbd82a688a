"""Raw records to normalised change events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.decimals import byte_digits, decimal_from_digits
from tidemark.functions.rows import computed_once
from tidemark.schemas import AMOUNT_PRECISION, AMOUNT_SCALE, DELETE_OP, Entity

_POSITION = ("topic", "kafka_partition", "offset", "kafka_timestamp_utc")
# --- fixed values: names of the technical columns and their places in the envelope ---
_METADATA_PATHS = {
    "cdc_operation": "op",
    "source_lsn": "source.lsn",
    "source_tx_id": "source.txId",
    "source_sequence": "source.sequence",
    "source_ts_ms": "source.ts_ms",
    "cdc_ts_ms": "ts_ms",
    "before": "before",
    "after": "after",
}
# --- end of fixed values ---


def decode(raw: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Drop tombstones and read key and value bytes as text; ``carry`` keeps more columns."""
    return raw.where(F.col("value_raw").isNotNull()).select(
        *_POSITION,
        *carry,
        F.col("key_raw").cast("string").alias("key_json"),
        F.col("value_raw").cast("string").alias("value_json"),
    )


def _carried(decoded: DataFrame) -> list[str]:
    known = (*_POSITION, "key_json", "value_json")
    return [c for c in decoded.columns if c not in known]


def parse(decoded: DataFrame, entity: Entity) -> DataFrame:
    """Flatten the change envelope, wrapped in ``payload`` or bare.

    Malformed text gives a row of nulls, which ``typed`` labels.
    """
    kept = [*_POSITION, *_carried(decoded)]
    document = F.from_json("value_json", entity.envelope)
    opened = computed_once(decoded, document, *kept)
    fields = [
        F.coalesce(f"payload.{path}", path).alias(name)
        for name, path in _METADATA_PATHS.items()
    ]
    return opened.select(*kept, *fields)


def _image() -> Column:
    """The row image a change speaks about: the last one for a delete, else the new one."""
    return F.when(F.col("cdc_operation") == DELETE_OP, F.col("before")).otherwise(F.col("after"))


def with_image(parsed: DataFrame, entity: Entity) -> DataFrame:
    """Replace ``before`` and ``after`` by the fields of the image that applies."""
    kept = [c for c in parsed.columns if c not in ("before", "after")]
    return parsed.select(*kept, _image().alias("image")).select(
        *[F.col(f"image.{f}").alias(f) for f in entity.fields], *kept
    )


def typed(parsed: DataFrame, entity: Entity) -> DataFrame:
    """Normalised events plus ``reject_reason``, null where the record is sound.

    Nothing is dropped here: a record is either an event or carries the reason why not. An
    operation of an unknown kind is an event; ``domain_audit`` counts those.
    """
    business = entity.fields[:3]
    technical = [c for c in entity.event_columns if c not in entity.fields]
    carried = [c for c in parsed.columns if c not in (*technical, "before", "after")]
    text = with_image(parsed, entity).withColumn("_digits", byte_digits(F.col("amount")))
    values = F.struct(
        F.col("amount").alias("_amount"),
        F.col("created_at").alias("_created_at"),
        F.col("updated_at").alias("_updated_at"),
        decimal_from_digits(F.col("_digits"), AMOUNT_PRECISION, AMOUNT_SCALE).alias("amount"),
        F.try_to_timestamp("created_at").alias("created_at"),
        F.try_to_timestamp("updated_at").alias("updated_at"),
    )
    checked = computed_once(text, values, *business, *technical, *carried)

    def unread(name: str) -> Column:
        return F.col(f"_{name}").isNotNull() & F.col(name).isNull()

    reason = (
        F.when(F.col("cdc_operation").isNull(), "unreadable")
        .when(F.col(entity.key).isNull(), "missing_key")
        .when(F.col("source_lsn").isNull(), "missing_position")
        .when(unread("amount"), "bad_amount")
        .when(unread("created_at") | unread("updated_at"), "bad_timestamp")
    )
    return checked.select(*entity.event_columns, *carried, reason.alias("reject_reason"))


def normalize(parsed: DataFrame, entity: Entity) -> DataFrame:
    """Typed business columns and technical columns of every sound event."""
    return typed(parsed, entity).where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(parsed: DataFrame, entity: Entity) -> DataFrame:
    """Identity of every record ``normalize`` leaves out, with the reason."""
    rejected = typed(parsed, entity).where(F.col("reject_reason").isNotNull())
    return rejected.select(*_POSITION, "reject_reason")


def events(raw: DataFrame, entity: Entity, carry: Sequence[str] = ()) -> DataFrame:
    """Raw records to normalised events: decode, parse, normalise."""
    return normalize(parse(decode(raw, carry), entity), entity)


def operation_profile(normalized: DataFrame) -> DataFrame:
    """Events per topic and operation."""
    return normalized.groupBy("topic", "cdc_operation").agg(F.count("*").alias("events"))
