import random

import pytest

from tidemark.operators import offsets


def frame(spark, held):
    rows = [(t, p, o) for (t, p), os in held.items() for o in os]
    return spark.createDataFrame(rows, "topic string, kafka_partition int, offset bigint").repartition(5)


def expected(held):
    out = set()
    for (t, p), os in held.items():
        found = sorted(set(os))
        out |= {(t, p, a + 1, b - 1, b - a - 1) for a, b in zip(found, found[1:]) if b - a > 1}
    return out


HELD = {
    ("a", 0): [*range(10), *range(12, 40), 40, 40, 100],
    ("a", 1): [7],
    ("b", 0): [*range(32_760, 32_775), 65_535, 65_536, 200_000],  # borders of bitmaps, and whole ones missing
    ("b", 1): [*range(30_000, 70_000)],
    ("b", 2): [2**40, 2**40 + 1, 2**40 + 70_000, 2**40 + 70_003],
    ("c", 0): random.Random(4).sample(range(150_000), 5000),
}


def test_gaps(spark):
    assert {tuple(r) for r in offsets.gaps(frame(spark, HELD)).collect()} == expected(HELD)
    assert offsets.gaps(frame(spark, HELD).limit(0)).count() == 0


def test_coverage(spark):
    found = offsets.coverage(offsets.presence(frame(spark, HELD)))
    assert {(r.topic, r.kafka_partition): (r.rows, r.offsets, r.from_offset, r.to_offset) for r in found.collect()} == {
        k: (len(v), len(set(v)), min(v), max(v)) for k, v in HELD.items()}


def test_gaps_by_a_column(spark):
    both = [frame(spark, {("a", 0): [1, 2, 5]}).selectExpr("1 AS day", "*"),
            frame(spark, {("a", 0): [3, 4]}).selectExpr("2 AS day", "*")]
    found = offsets.gaps(both[0].unionByName(both[1]), by=("day",))
    assert [tuple(r) for r in found.collect()] == [(1, "a", 0, 3, 4, 2)]


@pytest.mark.parametrize("rows", [200_000])
def test_what_travels_are_bitmaps(spark, rows):
    held = spark.range(rows).selectExpr("'t' AS topic", "0 AS kafka_partition", "id AS offset")
    plan = offsets.presence(held)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap" in plan.split("Exchange")[1]  # made before the exchange
    assert offsets.presence(held).count() == rows // 2**15 + 1
