import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import rules


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_counts(name, request):
    docs = request.getfixturevalue(name)
    want = sorted(((r.doc_id, *counts(r.text)) for r in docs.collect()), key=str)
    got = rules.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_binomial_tail(spark):
    for k, n, p in [(0, 100, 0.01), (3, 1000, 0.01), (20, 5000, 0.005), (9, 10, 0.3), (0, 0, 0.1)]:
        got = spark.range(1).select(rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-9)


def measured(spark, n, noise):
    rows = [(i, "en", 100, 500, (i * 7919 % 1000) // 10 if i % 10 == noise else 0, 0, 0, 0, 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, "
                                 "n_dup_lines long, n_repeat_words long, n_marks long, n_upper long")


def test_cutoffs_are_certified_and_catch_bad_text(spark):
    data = measured(spark, 20_000, 3)
    labels = data.select("doc_id", (F.col("n_symbols") <= 20).cast("int").alias("quality"))
    cutoffs = rules.calibrate(data, labels)
    symbols = cutoffs.where("rule = 'symbols'").first()
    assert symbols and symbols.tail <= 0.05 / len(rules.RULES)
    judged = rules.judge(data, cutoffs).join(labels, "doc_id")
    assert judged.where("quality = 1 and not kept").count() <= 0.05 * judged.where("quality = 1").count()
    assert judged.where("quality = 0 and kept").count() < 0.2 * judged.where("quality = 0").count()


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0


def plain_cutoffs(rows, labels, risk=0.05, doubt=0.05):
    """The same choice, document by document."""
    ratio = lambda r, top, bottom: getattr(r, top) / getattr(r, bottom) if getattr(r, bottom) else 0.0
    strata = {}
    for r in rows:
        if r.doc_id in labels and not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words):
            half = zlib.crc32(f"half:{r.doc_id}".encode()) % 2
            values = {name: ratio(r, *c) for name, c in rules.RULES.items()}
            strata.setdefault(r.lang, ([], []))[half].append((labels[r.doc_id], values))
    paths = {}
    for lang, (half, _) in strata.items():
        good, bad = [[v for g, v in half if g == kind] for kind in (1, 0)]
        if not good:
            continue
        best, path = {}, []
        for step, level in enumerate(rules.LEVELS):
            for name in rules.RULES:
                ordered = sorted(v[name] for v in good)
                cut = ordered[max(0, math.ceil(level * len(ordered)) - 1)]
                hit = lambda docs: sum(v[name] > cut for v in docs) / max(len(docs), 1)  # noqa: B023, E731
                gain = hit(bad) - rules.GOOD_COST * hit(good)
                if name not in best or gain > best[name][0]:
                    best[name] = (gain, cut)
            path.append({name: cut for name, (gain, cut) in best.items() if gain > 0})
        paths[lang] = path
    out = set()
    for lang, path in paths.items():
        good = [v for g, v in strata[lang][1] if g]
        chosen = {}
        for cuts in path:
            k = sum(any(v[name] > cut for name, cut in cuts.items()) for v in good)
            if not good or tail(k, len(good), risk) > doubt / len(paths):
                break
            chosen = {name: (cut, len(good), k) for name, cut in cuts.items()}
        out |= {(lang, name, *c) for name, c in chosen.items()}
    return out


def test_cutoffs_are_those_of_a_plain_search(spark):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        good = i % 4 != 0
        noise = lambda much: int(draw.expovariate(1 / (much if not good and draw.random() < 0.5 else 2)))  # noqa: B023, E731
        lang = ["en", "de", "fr", None][i % 7 % 4] if i % 50 else "rare"
        rows.append((i, lang, 100, 500, noise(40), noise(2), 0, noise(20), noise(60)))
        labels.append((i, int(good)))
    data = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, "
                                 "n_dup_lines long, n_repeat_words long, n_marks long, n_upper long")
    cutoffs = rules.calibrate(data, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {tuple(r)[:5] for r in cutoffs.collect()}
    want = plain_cutoffs(data.collect(), dict(labels))
    assert got == want
    assert {r[0] for r in got} == {"en", "de", "fr", None}  # and too few labels for the rare one
    judged = rules.judge(data, cutoffs)
    assert {r.lang for r in judged.where("not certified").select("lang").distinct().collect()} == {"rare"}


def test_few_labels_certify_nothing(spark):
    data = measured(spark, 300, 3)
    labels = data.select("doc_id", F.lit(1).alias("quality"))
    assert rules.calibrate(data, labels).count() == 0
    assert rules.judge(data, rules.calibrate(data, labels.limit(0))).where("not kept").count() == 0


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    found = rules.judge(rules.measure(odd), rules.calibrate(rules.measure(odd), labels))
    assert found.count() == odd.count() and found.where("n_words < 10 and kept").count() == 0
    nothing = rules.measure(odd.limit(0))
    assert rules.judge(nothing, rules.calibrate(nothing, labels.limit(0))).count() == 0
