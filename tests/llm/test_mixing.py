import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def shares(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def checked(docs):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want = shares(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken // max(r.size, 1) >= (r.epochs if r.size else 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    return rows


def test_the_supplied_table(docs):
    rows = checked(docs)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_one_large_source(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 11}") for i in range(3000)]
    checked(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_odd_rows_and_empty_tables(odd):
    assert len(checked(odd)) == odd.count()
    assert mixing.mix(odd.limit(0)).count() == 0


def test_documents_follow_the_mix(docs):
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, r in rows.items():
        if r.size:
            part = r.taken - r.epochs * r.size
            assert times.get(i, 0) == r.epochs + (part * 2 >= r.size)


def test_tidy_text_is_taken_sooner(spark):
    rows = [(i, "plain words only " * 20 if i % 2 else "#$ %& @@ !! " * 20, "s" if i < 2000 else "t") for i in range(4000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).collect()
    tidy = sum(r.taken > 0 for r in found if r.doc_id % 2)
    assert tidy > 1.5 * sum(r.taken > 0 for r in found if not r.doc_id % 2)


def test_bins_hold_a_small_part_of_any_source(spark):
    """Also of a source whose texts are full of signs, so that its weights are low."""
    text = F.when(F.col("id") % 2 == 0, F.lit("plain words")).otherwise(F.lit("#1$22 %&*33 44|55<>"))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    fullest = mixing.keyed(docs).groupBy("source", "bin").count().groupBy("source").agg(F.max("count")).collect()
    assert len(fullest) == 2 and all(r[1] < 60 for r in fullest)
