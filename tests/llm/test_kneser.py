import math
import os
from collections import Counter, defaultdict

import pytest

from tidemark.llm import kneser


def model_of(texts, order=kneser.ORDER):
    """The same model in plain Python: the probability of a character after a context."""
    top = Counter()
    for t in texts:
        t = kneser.START * (order - 1) + t + kneser.END
        top.update(t[i:i + order] for i in range(len(t) - order + 1))
    tables = [top]
    for k in range(order - 1, 0, -1):
        tables.append(Counter(g[-k:] for g in tables[-1]))
    tables.reverse()
    letters = len(tables[0]) + 1
    parts = []
    for counts in tables:
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            ratios = (2 * n[1] / n[0], 3 * n[2] / n[1], 4 * n[3] / n[2] if n[2] else 0.0)
            d = [min(max(k - y * r, 0.05 * k), k) for k, r in zip((1, 2, 3), ratios)]
        else:
            d = [0.5, 1.0, 1.5]
        total, cut = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            cut[g[:-1]] += d[min(c, 3) - 1]
        parts.append((counts, total, cut, d))

    def probability(gram):
        p = 1 / letters
        for k, (counts, total, cut, d) in enumerate(parts, 1):
            g = gram[-k:]
            if total.get(g[:-1]):
                c = counts.get(g, 0)
                p = (c - d[min(c, 3) - 1] if c else 0) / total[g[:-1]] + cut[g[:-1]] / total[g[:-1]] * p
        return p

    return probability


def test_losses_against_plain_python(spark, docs):
    trusted = docs.where("doc_id % 3 = 0 and lang = 'fr'")
    probability = model_of([r.text for r in trusted.collect()])
    some = docs.where("doc_id % 10 = 1")
    got = {r.doc_id: r for r in kneser.score(some, trusted).collect()}
    for r in some.collect():
        t = kneser.START * (kneser.ORDER - 1) + r.text + kneser.END
        loss = [-math.log(probability(t[i:i + kneser.ORDER])) for i in range(len(r.text) + 1)]
        assert got[r.doc_id].n == len(loss)
        assert got[r.doc_id].loss == pytest.approx(sum(loss) / len(loss), rel=1e-9)


def test_probabilities_sum_to_one(docs):
    texts = [r.text for r in docs.where("lang = 'es'").collect()]
    probability = model_of(texts)
    letters = {c for t in texts for c in t} | {kneser.END}
    seen = sum(probability("lo " + c) for c in letters)
    unseen = probability("lo " + "一")
    assert seen + unseen == pytest.approx(1, abs=1e-9)


def test_junk_goes_and_clean_text_stays(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = kneser.classify(docs, labels).join(labels, "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1]
    bad = [r.kept for r in found if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) < 0.5 * len(bad)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_every_kind_of_junk_goes_at_every_size(spark, sf, size):
    folder = f"{os.path.dirname(sf)}/{size}"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    judged = kneser.classify(docs, labels).select("doc_id", "kept")
    gone = defaultdict(list)
    for r in docs.select("doc_id", "text").join(judged, "doc_id").join(labels, "doc_id").collect():
        words = r.text.split()
        repeated = len(words) >= 10 and len(set(words)) < 0.3 * len(words)
        kind = ("toxic" if r.toxic else "clean") if r.quality else ("repeated" if repeated else "other")
        gone[kind].append(not r.kept)
    share = {kind: sum(rows) / len(rows) for kind, rows in gone.items()}
    assert share["repeated"] > 0.8 and share["other"] > 0.9, share
    assert share["clean"] < 0.002 and share["toxic"] < 0.03, share


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame(
        [(5, 1, 0), (4, 1, None), (7, 1, 0), (7, 0, 0), (8, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = kneser.classify(odd, labels)
    assert found.count() == odd.count()
    assert all(r.kept for r in found.where("n = 1").collect())
    assert kneser.classify(odd.limit(0), labels).count() == 0
    untrained = kneser.classify(odd, labels.limit(0))
    assert untrained.count() == odd.count() and untrained.where("not kept or perplexity is not null").count() == 0
