import json

from helpers import change, image, raw_frame

from tidemark.operators import drift, events
from tidemark.schemas import ORDERS


def found(spark, values, **more):
    rows = drift.drift(events.decode(raw_frame(spark, values)), ORDERS, **more).collect()
    return {(r.path, r.found, r.expected, r.verdict): r.occurrences for r in rows}


def test_sound_envelopes_do_not_drift(spark):
    assert found(spark, [change("c", after=image()), change("u", image(), image(), wrapped=False), None,
                         change("d", before=image())]) == {}


def test_unknown_and_retyped(spark):
    extra = json.loads(change("u", image(), image(channel="web", price=1.5)))
    extra["payload"]["source"]["lsn"] = "12"
    extra["payload"]["before"] = "gone"
    extra["schema"] = {"type": "struct", "fields": [{"a": 1}, {"a": 2}, {}]}
    numbers = json.loads(change("c", after=image(amount=7), wrapped=False))
    assert found(spark, [json.dumps(extra), json.dumps(numbers)]) == {
        ("$.after.channel", "STRING", None, "unknown"): 1, ("$.after.price", "DECIMAL", None, "unknown"): 1,
        ("$.source.lsn", "STRING", "BIGINT", "retyped"): 1, ("$.before", "STRING", "OBJECT", "retyped"): 1,
        ("$.schema.type", "STRING", None, "unknown"): 1, ("$.schema.fields[].a", "BIGINT", None, "unknown"): 2,
        ("$.schema.fields[]", "OBJECT", None, "unknown"): 1, ("$.after.amount", "BIGINT", "STRING", "retyped"): 1}


def test_what_is_no_envelope(spark):
    assert found(spark, ["not json", "", "5", "[1, 2]", '{"payload": 3}', "null"]) == {
        ("$", None, "OBJECT", "unreadable"): 2, ("$", "BIGINT", "OBJECT", "retyped"): 2,
        ("$[]", "BIGINT", None, "unknown"): 2}


def test_deep_values_are_counted_where_opening_stops(spark):
    deep = {"op": "c", "after": image(nested={"a": {"b": {"c": {"d": 1}}}})}
    assert found(spark, [json.dumps(deep)], depth=3) == {("$.after.nested.a", "OBJECT", None, "unknown"): 1}
    assert found(spark, [json.dumps(deep)], depth=9) == {("$.after.nested.a.b.c.d", "BIGINT", None, "unknown"): 1}


def test_documents_are_read_in_one_stage(spark):
    rows = drift.drift(events.decode(raw_frame(spark, [change("c", after=image())])), ORDERS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("parseJson") == 1
