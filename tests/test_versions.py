import random

import pytest
from helpers import event, event_frame

from tidemark.operators import versions
from tidemark.schemas import ORDERS


def changes(seed=1, keys=6, count=400):
    """Mostly of one key, with copies of a change at a later offset."""
    rng, out, seen = random.Random(seed), [], set()
    for offset in range(count):
        key = "hot" if rng.random() < 0.7 else str(rng.randrange(keys))
        lsn = rng.randrange(10 * count)
        if (key, lsn) not in seen:
            seen.add((key, lsn))
            copies = [offset] if rng.random() < 0.8 else [offset, offset + 10_000]
            out += [event(key, lsn, o, rng.choice(ORDERS.states), rng.choice("cud")) for o in copies]
    return out


def fields(row):
    return dict(zip(ORDERS.event_columns, row))


def by_hand(rows):
    out = {}
    for r in map(fields, rows):
        key = (r["id_order"], r["source_lsn"])
        out[key] = max(out.get(key, -1), r["offset"])
    spans = {}
    for key, lsn in out:
        later = [x for k, x in out if k == key and x > lsn]
        spans[key, lsn, out[key, lsn]] = min(later) if later else None
    return spans


@pytest.mark.parametrize("hot", [10, 40, 1_000_000])
def test_versions(spark, hot):
    rows = changes()
    found = versions.versions(event_frame(spark, rows).repartition(5), ORDERS, hot=hot)
    assert {(r.id_order, r.source_lsn, r.offset): r.valid_to_lsn for r in found.collect()} == by_hand(rows)


def test_at_position(spark):
    rows = changes(2)
    valid = versions.versions(event_frame(spark, rows), ORDERS)
    for lsn in (-1, 700, 2500, 10**6):
        due = {}
        for r in sorted(map(fields, rows), key=lambda r: (r["source_lsn"], r["offset"])):
            if r["source_lsn"] <= lsn:
                due[r["id_order"]] = (r["status_order"], r["cdc_operation"])
        due = {k: s for k, (s, op) in due.items() if op != "d"}
        assert {r.id_order: r.status_order for r in versions.at_position(valid, lsn).collect()} == due


@pytest.mark.parametrize("hot", [7, 60, 1_000_000])
def test_as_of(spark, hot):
    rng = random.Random(3)
    right = [(rng.choice("aaaaab"), rng.randrange(300), i, f"v{i}") for i in range(150)] + [(None, 5, 999, "null key")]
    left = [(i, rng.choice("aaaabc"), rng.randrange(-5, 320)) for i in range(200)] + [(900, None, 50), (901, "a", 300)]
    a = spark.createDataFrame(left, "id long, k string, at long").repartition(3)
    b = spark.createDataFrame(right, "key string, pos long, n long, v string").repartition(4)
    found = versions.as_of(a, b.withColumnsRenamed({"key": "k", "pos": "at"}), "k", "at", "n", ("v",), hot=hot)
    due = {}
    for i, k, at in left:
        met = [r for r in right if k is not None and r[0] == k and r[1] <= at]
        due[i] = max(met, key=lambda r: (r[1], r[2]))[3] if met else None
    assert found.columns == ["id", "k", "at", "v"]
    assert {r.id: r.v for r in found.collect()} == due


def test_a_row_moves_once(spark):
    rows = event_frame(spark, changes())
    found = versions.as_of(rows.select("id_order", "source_lsn"), rows.select("id_order", "source_lsn", "offset", "status_order"),
                           "id_order", "source_lsn", "offset", ("status_order",))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    none = event_frame(spark, [])
    assert versions.versions(none, ORDERS).count() == 0
    assert versions.as_of(none.select("id_order", "source_lsn"), none.select("id_order", "source_lsn", "offset"),
                          "id_order", "source_lsn", "offset", ("offset",)).count() == 0


def test_sides_are_made_once_when_keys_are_divided(spark):
    rows = event_frame(spark, changes())
    left = rows.select("id_order", "source_lsn")
    right = rows.select("id_order", "source_lsn", "offset", "status_order")
    found = versions.as_of(left, right, "id_order", "source_lsn", "offset", ("status_order",), hot=7)
    read = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in read and "Relation" in read and "RDD" not in read and "LocalRelation" not in read
    assert found.count() == rows.count()
