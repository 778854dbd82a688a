from helpers import event, event_frame, raw_frame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import quality
from tidemark.schemas import ORDERS, PAYMENTS


def test_domain_audit_counts_each_rule(spark):
    df = event_frame(spark, [event("A", 1, 1, "CREATED", "c"), event("B", 1, 2, "LOST", "u"),
                             event(None, 1, 3, "SHIPPED", "x")])
    amounts = F.when(F.col("offset") == 1, -1).when(F.col("offset") == 2, 0)
    found = {r.rule: r.violations for r in quality.domain_audit(
        df.withColumn("amount", amounts.cast("decimal(10,2)")), ORDERS).collect()}
    assert (found["status_domain"], found["amount_bound"], found["operation_domain"]) == (1, 1, 1)
    assert (found["id_order_not_null"], found["amount_not_null"], found["topic_not_null"]) == (1, 1, 0)


def test_zero_is_allowed_for_orders_only(spark):
    row = spark.createDataFrame([("P1", 0)], "id_payment string, n int").select(
        "id_payment", F.col("n").cast("decimal(10,2)").alias("amount"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in PAYMENTS.event_schema
          if f.name not in ("id_payment", "amount")])
    found = {r.rule: r.violations for r in quality.domain_audit(row, PAYMENTS).collect()}
    assert found["amount_bound"] == 1


def test_referential_audit_ignores_null_references(spark):
    child = spark.createDataFrame([("1", "a"), ("2", "x"), ("3", None)], "id string, ref string")
    parent = spark.createDataFrame([("a",)], "key string")
    out = quality.referential_audit(child, "ref", parent, "key", ["id"])
    assert [tuple(r) for r in out.collect()] == [("2", "x")]


def test_type_audit(spark):
    held = spark.createDataFrame([("1", 2, None), ("2", None, "x")], "a string, b int, `odd.name` string")
    stated = T.StructType.fromDDL("a string, b bigint, c date")
    assert sorted(map(tuple, quality.type_audit(held, stated).collect())) == [
        ("a", "string", "string", "ok", 2), ("b", "bigint", "int", "retyped", 1),
        ("c", "date", None, "missing", 0), ("odd.name", None, "string", "unexpected", 1)]
    assert {r.held_values for r in quality.type_audit(held.limit(0), stated).collect()} == {0}


def test_reconcile_names_every_difference(spark):
    left = raw_frame(spark, ["a", "b", "c", "d"]).unionByName(raw_frame(spark, ["a"]))
    right = raw_frame(spark, ["a", "b", "c"]).where("offset > 0").unionByName(
        raw_frame(spark, ["a", "b"])).unionByName(raw_frame(spark, ["z"], partition=5))
    out = quality.reconcile(left, right)
    assert {(r.kafka_partition, r.offset): r.verdict for r in out.collect()} \
        == {(0, 0): "fewer", (0, 1): "doubled", (0, 3): "lost", (5, 0): "unexpected"}
