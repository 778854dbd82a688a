import re
from collections import Counter

import corpus_pipeline
from tidemark.llm import kneser, mixing, packing
from tidemark.session import written


def test_each_stage_works_on_what_the_one_before_kept(spark, sf, docs):
    held, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        held[name] = before = written(stage(spark, before, sf), name)
    names = list(held)
    for name in names[:-1]:
        assert held[name].columns == docs.columns
    start = {r.doc_id: r for r in docs.collect()}
    after = {n: held[n].collect() for n in names}

    judged = kneser.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert {r.doc_id for r in after["quality_classifier"]} == kept < start.keys()

    sets = {r.doc_id: {tuple(w[i:i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))}
            for r in after["quality_classifier"]}
    left = {r.doc_id for r in after["near_duplicates"]}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert left < kept
    assert not any(near(a, b) for a in left for b in left if a < b)
    assert all(any(near(a, b) for b in kept if b != a) for a in kept - left)

    masked = {r.doc_id: r.text for r in after["secret_scan"]}
    secret = re.compile(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}|[0-9a-f]{40}")
    assert masked.keys() == left and not any(map(secret.search, masked.values()))
    assert all(masked[i] == start[i].text for i in left if not secret.search(start[i].text))

    copies = Counter(r.doc_id for r in after["source_mix"])
    assert all(n <= 2 for n in copies.values())
    assert {r.text for r in after["source_mix"]} <= set(masked.values())
    taken = mixing.mix(held["secret_scan"]).groupBy("source").sum("taken").collect()
    assert {r.source for r in held["source_mix"].select("source").distinct().collect()} <= {r.source for r in taken}

    tokens = {r.doc_id: r.doc_tokens for r in packing.pack(held["secret_scan"]).collect()}
    total = Counter()
    for r in after["sequences"]:
        total[r.doc_id] += r.length
    assert total == Counter({i: tokens[i] * n for i, n in copies.items()})


def test_one_row_of_each_group_of_near_copies_stays(spark, sf, odd):
    long = [" ".join(f"{letter}{i}" for i in range(60)) for letter in "pqrstu"]
    near = [t + " end" for t in long]
    more = [
        (None, long[0]), (None, long[1]), (None, near[1]), (None, long[2]), (None, long[2]),  # no ids
        (900, long[3]), (901, near[3]), (901, "an own text under a shared id"),
        (902, long[4]), (902, near[4]), (910, near[4]),
        (903, long[5]), (903, long[5]), (None, near[5])]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    found = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert found.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in found.collect())

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wordless = Counter(r for r in rows if not (r[1] or "").split())
    sets = {r: {tuple(w[i:i + 5]) for w in [r[1].lower().split()] for i in range(max(1, len(w) - 4))}
            for r in rows if r not in wordless}
    groups = []
    for r in sets:
        near_r = [g for g in groups if any(len(sets[r] & sets[x]) >= 0.8 * len(sets[r] | sets[x]) for x in g)]
        groups = [g for g in groups if g not in near_r] + [[r, *sum(near_r, [])]]
    assert sum(kept.values()) == len(groups) + sum(wordless.values())
    for group in groups:
        low = min((i is None, i or 0) for i, _ in group)
        left = [r for r in group if kept[r]]
        assert len(left) == 1 and kept[left[0]] == 1 and (left[0][0] is None, left[0][0] or 0) == low
    assert all(kept[r] == n for r, n in wordless.items())


def test_stages_keep_columns_whatever_their_names(spark, sf, odd):
    before = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf), name)
        assert after.schema.names == odd.columns and after.count() > 0
        if name != "source_mix":  # which repeats rows
            assert after.exceptAll(before).count() == 0
        before = after


def test_empty_documents(spark, sf, docs):
    before = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = written(stage(spark, before, sf), name)
        assert before.count() == 0
