"""Derive Kafka-shaped change records from the supplied tables.

Every order, and every order's payment and refunded items, becomes a life of changes:
insert, updates, sometimes a delete with its tombstone, sometimes a redelivered copy.
Which of them occur follows from the row's own columns.

Slot numbers of a life: 0 insert, 1-4 updates, 5 delete, 6 tombstone, 7 redelivery.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import ENTITIES, Entity
from tidemark.streaming.landing import project

PARTITIONS = 6  # Kafka partitions per topic
SLOTS = 8       # offsets reserved per key
INSERT, DELETE, TOMBSTONE, REDELIVERY = 0, 5, 6, 7

# Month whose pending rows are deleted at the source in the end.
DELETED_IN = {"orders": 12, "payments": 11, "refunds": 10}

_ZONES = {"F": "Z", "O": "+00:00", "P": "-03:00"}
_ZONE_SHIFT = {"F": 0, "O": 0, "P": -3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def _traits(spark: SparkSession, sf_dir: str, entity: Entity) -> DataFrame:
    """One row per key: which changes its life holds, and their raw material, without names made from it."""
    orders = table(spark, sf_dir, "orders")
    month = F.month("o_orderdate")
    traits = orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("custkey"),
        _cents(F.col("o_totalprice")).alias("cents"),
        F.col("o_orderstatus").alias("kind"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("depth"),
        F.col("o_orderdate").cast("timestamp").alias("day"),
        ((F.col("o_orderstatus") == "P") & (month == DELETED_IN[entity.name])).alias("deleted"),
        (month == 6).alias("redelivered"),
        (month == 3).alias("mirrored"),
    )
    if entity.name != "refunds":
        return traits
    returned = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.sum(_cents(F.col("l_extendedprice"))).alias("refund_cents"))
    )
    # Sizes guessed from compressed files are too small: by them, keys of all orders could be broadcast.
    return traits.join(returned.hint("merge"), "k").withColumn("cents", F.col("refund_cents")).drop("refund_cents")


def _named(rows: DataFrame, entity: Entity) -> DataFrame:
    """``rows`` with the key of their own row and of the one it refers to."""
    own = F.col("k").cast("string")
    of_payment = F.concat(F.lit("P"), own)
    names = {"orders": (own, F.col("custkey").cast("string")), "payments": (of_payment, own),
             "refunds": (F.concat(F.lit("R"), own), of_payment)}
    key, ref = names[entity.name]
    return rows.withColumn("id", key).withColumn("ref", ref)


def lives(spark: SparkSession, sf_dir: str, entity: Entity) -> DataFrame:
    """One row per key: which changes its life holds, and their raw material."""
    return _named(_traits(spark, sf_dir, entity), entity)


def encoded(cents: Column) -> Column:
    """Base64 of the shortest big-endian two's-complement form."""
    digits = F.hex(cents)
    spare = F.when(F.substring(digits, 1, 1) >= "8", 2).otherwise(1)  # a digit from 8 on would read as a sign
    whole = F.shiftleft(F.shiftright(F.length(digits) + spare, 1), 1)
    shortest = F.when(cents >= 0, F.lpad(digits, whole, "0")).otherwise(
        F.regexp_extract(digits, "^(?:FF(?=[89A-F]))*((?:..)+)$", 1))
    return F.base64(F.unhex(shortest))


def _by_kind(values: dict) -> Column:
    """The value of the order's kind; other kinds are taken for P."""
    return F.when(F.col("kind") == "F", values["F"]).when(F.col("kind") == "O", values["O"]).otherwise(values["P"])


def _clock(at: Column) -> Column:
    """Time on the clock of the order's zone."""
    return F.date_format(F.timestamp_add("HOUR", _by_kind(_ZONE_SHIFT), at), "yyyy-MM-dd'T'HH:mm:ss")


def _iso(slot: Column) -> Column:
    """Zoned ISO text of the time of change ``slot``, the zone depending on the order's kind. While its date is that of
    the life's begin, only the hour differs."""
    hour = F.col("begin_hour") + slot
    same = F.concat(F.col("begin_date"), F.get(F.array(*[F.lit(f"{h:02}") for h in range(24)]), hour), F.col("begin_rest"))
    return F.concat(F.coalesce(same, _clock(_hours(slot))), _by_kind(_ZONES))


def _with_begin(rows: DataFrame) -> DataFrame:
    """``rows`` of lives with the pieces of the text of their begin: up to the hour, the hour, after it."""
    text = F.col("begin")
    return rows.withColumn("begin", _clock(F.col("day"))).select(
        *rows.columns, _quoted(F.concat(text, _by_kind(_ZONES))).alias("created"),
        F.left(text, F.length(text) - 8).alias("begin_date"),
        F.substring(text, -8, 2).cast("int").alias("begin_hour"), F.right(text, F.lit(6)).alias("begin_rest"))


def _hours(count: Column) -> Column:
    return F.timestamp_add("HOUR", count, F.col("day"))


def _quoted(text: Column) -> Column:
    """``text``, made of letters, digits and marks that need no escape, as JSON."""
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _object(**fields: Column) -> Column:
    """JSON of an object, from the JSON of its fields."""
    parts = [p for name, value in fields.items() for p in (F.lit(f',"{name}":'), value)]
    return F.concat(F.lit(f'{{"{next(iter(fields))}":'), *parts[1:], F.lit("}"))


def _row_image(entity: Entity, slot: Column) -> Column:
    """JSON of the table row as it stood after change ``slot``."""
    states = F.array(*[F.lit(s) for s in entity.states])
    return _object(**{
        entity.key: _quoted(F.col("id")),
        entity.ref: _quoted(F.col("ref")),
        entity.status: _quoted(F.get(states, slot)),
        "amount": _quoted(encoded(F.col("cents") + slot * 100)),
        "created_at": F.col("created"),
        "updated_at": _quoted(_iso(slot)),
    })


def _slots() -> Column:
    """Slots of a life."""
    return F.concat(
        F.sequence(F.lit(INSERT), F.col("depth")),
        F.when(F.col("deleted"), F.array(F.lit(DELETE), F.lit(TOMBSTONE)))
        .otherwise(F.array().cast("array<int>")),
        F.when(F.col("redelivered"), F.array(F.lit(REDELIVERY)))
        .otherwise(F.array().cast("array<int>")),
    )


def _each_change(rows: DataFrame) -> DataFrame:
    """``rows`` of lives, one per slot in ``slots``, with ``src``, the change told."""
    last = F.when(F.col("deleted"), DELETE).otherwise(F.col("depth"))
    src = F.when(F.col("slot") == REDELIVERY, last).otherwise(F.col("slot"))
    kept = [c for c in rows.columns if c not in ("slots", "slot")]
    return rows.select(*kept, F.explode("slots").alias("slot")).withColumn("src", src)


def changes(spark: SparkSession, sf_dir: str, entity: Entity) -> DataFrame:
    """One row per record: its life's columns, ``slot``, and ``src``, the change told."""
    return _each_change(lives(spark, sf_dir, entity).withColumn("slots", _slots()))


def _by_quarter(rows: DataFrame) -> DataFrame:
    """``rows`` of lives, one per quarter in which some of their ``slots`` were sent; ``slot`` is the first of those."""
    def quarter(slot: Column) -> Column:
        return F.date_trunc("quarter", sent_at(slot))

    own, slots = F.transform("slots", quarter), F.col("slots")
    several = F.transform(F.array_distinct(own), lambda q: F.filter(slots, lambda s: quarter(s).eqNullSafe(q)))
    one = quarter(F.array_min("slots")).eqNullSafe(quarter(F.array_max("slots")))
    parts = F.when(one, F.array(slots)).otherwise(several)
    kept = [c for c in rows.columns if c != "slots"]
    return rows.select(*kept, F.explode(parts).alias("slots")).withColumn("slot", F.array_min("slots"))


def sent_at(slot: Column | None = None) -> Column:
    """Time of a record, from the row of ``changes`` behind it, or of a life's ``slot``."""
    return F.timestamp_add("SECOND", F.lit(1), _hours(F.col("slot") if slot is None else slot))


def kafka_records(spark: SparkSession, sf_dir: str, entity: Entity,
                  dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The records of one topic in the shape the Kafka source delivers. ``dealt`` places the rows of lives, one per quarter
    with the first ``slot`` in it, among tasks before their text, many times as large, is made.

    The images of a life are made once each, though most are told twice: before a change and after another."""
    told = _traits(spark, sf_dir, entity).withColumn("slots", _slots())
    if dealt:
        told = dealt(_by_quarter(told.drop("redelivered")))
    lived = _with_begin(_named(told, entity))
    images = F.transform(F.sequence(F.lit(INSERT), F.col("depth")), lambda slot: _row_image(entity, slot))
    src = F.col("src")
    lsn = F.col("k") * 1000 + src
    before_slot = F.when(src == DELETE, F.col("depth")).otherwise(src - 1)
    op = (
        F.when(src == DELETE, "d")
        .when(src > 0, "u")
        .when(F.col("kind") == "F", "r")
        .otherwise("c")
    )
    ts_ms = F.unix_millis(_hours(src))

    def image(told: Column, slot: Column) -> Column:
        """The image after change ``slot``. Slots of a life count from 0, upwards or downwards."""
        return F.coalesce(F.when(told, F.get("images", F.abs(slot))), F.lit("null"))

    change = _object(
        before=image(src > 0, before_slot),
        after=image(src != DELETE, src),
        source=_object(
            lsn=_number(lsn),
            txId=_number(F.col("k") * 10 + src),
            sequence=_quoted(F.concat(F.lit('[null,\\"'), lsn.cast("string"), F.lit('\\"]'))),
            ts_ms=_number(ts_ms),
        ),
        op=_quoted(op),
        ts_ms=_number(ts_ms + 250),
    )
    place = F.when(F.col("mirrored"), SLOTS - 1 - F.col("slot")).otherwise(F.col("slot"))
    value = F.when(F.col("kind") == "F", change).otherwise(
        F.concat(F.lit('{"payload":'), change, F.lit("}")))
    # The text of a change is never null. Said so, a filter on null values reads the slot alone.
    known = F.when(F.col("slot") != TOMBSTONE, F.coalesce(value, F.lit("")).cast("binary"))
    return _each_change(lived.withColumn("images", images)).select(
        F.lit(entity.topic).alias("topic"),
        F.pmod("k", F.lit(PARTITIONS)).cast("int").alias("partition"),
        (F.expr(f"k div {PARTITIONS}") * SLOTS + place).alias("offset"),
        sent_at().alias("timestamp"),
        F.to_json(F.struct(F.col("id").alias(entity.key))).cast("binary").alias("key"),
        known.alias("value"))


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows to as many tasks as shuffles have: the few tasks that read a well compressed table would each make
    the text of many records."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "k")


def raw_records(spark: SparkSession, sf_dir: str, entity: Entity,
                dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same records in landing columns, before any ingestion stamp."""
    return project(kafka_records(spark, sf_dir, entity, dealt))


ALL = tuple(ENTITIES.values())
