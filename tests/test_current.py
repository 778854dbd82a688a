import random
from datetime import date

from helpers import event, event_frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import current as state
from tidemark.operators import history as past
from tidemark.schemas import IDENTITY, ORDERS


def statuses(df):
    return {r.id_order: r.status_order for r in df.collect()}


def newest(rows):
    """Expectation in plain Python: per key the highest position, then the highest offset."""
    best = {}
    for key, lsn, offset, status in rows:
        if key not in best or (lsn, offset) > best[key][:2]:
            best[key] = (lsn, offset, status)
    return {key: status for key, (_, _, status) in best.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("pqrs"), st.integers(0, 5)), min_size=1, max_size=40),
       st.integers(1, 6), st.randoms(use_true_random=False))
def test_the_highest_position_then_offset_wins_in_any_order(spark, drawn, partitions, rng):
    rows = [(key, lsn, offset, f"s{offset}") for offset, (key, lsn) in enumerate(drawn)]
    rng.shuffle(rows)
    frame = event_frame(spark, [event(k, lsn, o, s) for k, lsn, o, s in rows])
    assert statuses(state.latest(frame.repartition(partitions), ORDERS)) == newest(rows)


def test_missing_log_position_loses(spark):
    df = event_frame(spark, [event("A", None, 9, "UNPLACED"), event("A", 1, 1, "PLACED")])
    assert statuses(state.latest(df, ORDERS)) == {"A": "PLACED"}


def test_active_leaves_deleted_keys_out(spark):
    df = event_frame(spark, [event("A", 1, 1), event("B", 1, 2), event("B", 2, 3, op="d")])
    assert set(statuses(state.active(state.latest(df, ORDERS)))) == {"A"}


def test_folding_batches_in_any_order_equals_rebuilding(spark):
    rng = random.Random(7)
    rows = [event(f"k{rng.randrange(12)}", rng.randrange(40), o, f"s{o}") for o in range(120)]
    expected = statuses(state.latest(event_frame(spark, rows), ORDERS))
    for _ in range(3):
        rng.shuffle(rows)
        cuts = [rows[:30], rows[30:90], rows[10:60], rows[90:]]
        now = event_frame(spark, [])
        for part in cuts:
            folded = state.fold(now, event_frame(spark, part), ORDERS)
            now = event_frame(spark, [tuple(r) for r in folded.collect()])
        assert statuses(now) == expected


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(0, 20000, 1, 4).select(F.col("id").alias("offset")).select(
        F.when(F.col("offset") % 3 == 0, F.col("offset").cast("string")).otherwise("HOT").alias("id_order"),
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("offset", "source_lsn")
          else F.col("offset").alias(f.name) for f in ORDERS.event_schema if f.name != "id_order"])
    out = state.latest(df, ORDERS)
    hot = out.where("id_order = 'HOT'").first()
    assert hot.offset == 19999
    plan = out._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan.split("Exchange")[1]
    assert "partial_max_by" in before_exchange


def test_history_holds_each_identity_once(spark):
    rows = [event("A", 1, 1), event("A", 2, 2)]
    df = event_frame(spark, rows + rows)
    assert past.distinct_events(df).count() == 2


def dated(spark, rows):
    """Event frame with a landing date: (offset, day)."""
    frame = event_frame(spark, [event("A", o, o) for o, _ in rows])
    numbered = [(*tuple(r), rows[i][1]) for i, r in enumerate(frame.collect())]
    return spark.createDataFrame(numbered, ORDERS.event_schema.add("ingestion_date_utc", "date"))


D = [date(2024, 5, d) for d in range(1, 6)]


def test_the_earliest_copy_stays_in_any_order(spark):
    rows = [(1, D[2]), (1, D[0]), (1, D[1]), (2, D[1]), (2, D[1])]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        found = past.distinct_events(dated(spark, order).coalesce(1)).collect()
        assert {(r.offset, r.ingestion_date_utc) for r in found} == {(1, D[0]), (2, D[1])}


def test_each_date_keeps_an_identity_once(spark):
    rows = dated(spark, [(8, D[0]), (9, D[0]), (9, D[0]), (9, D[1])])
    out = past.once_per_date(rows, rows.select("ingestion_date_utc", *IDENTITY))
    assert sorted((r.offset, r.ingestion_date_utc) for r in out.collect()) == [(8, D[0]), (9, D[0]), (9, D[1])]


def test_a_batch_without_repeats_is_not_shuffled(spark, tmp_path):
    dated(spark, [(n, D[0]) for n in range(10)]).write.parquet(str(tmp_path / "b"))
    batch = spark.read.parquet(str(tmp_path / "b"))
    out = past.once_per_date(batch, batch.select("ingestion_date_utc", *IDENTITY))
    assert out.count() == 10
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
