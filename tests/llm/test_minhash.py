import random
from math import comb

import pytest

from tidemark.llm import minhash


def shingle_set(text, words):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i:i + words]) for i in range(len(found) - words + 1))


def expected(rows, words):
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    place = list(range(len(sets)))

    def find(a):
        while place[a] != a:
            a = place[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                place[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)] = min(i, low.get(find(x), i))
    out = []
    for x, (i, s) in enumerate(sets):
        component = low.get(find(x)) if s else i
        out.append((i, len(s), component, i == component))
    return sorted(out, key=str)


def result(docs, words):
    return sorted(map(tuple, minhash.near_duplicates(docs, words).collect()), key=str)


def edited(text, share, draw):
    return " ".join(w if draw.random() > share else f"new{draw.randrange(10**6)}" for w in text.split())


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(spark, docs, words):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    draw = random.Random(words)
    base = " ".join(f"w{draw.randrange(10**5)}" for _ in range(120))
    rows += [(10_000 + k, edited(base, draw.choice([0.0, 0.01, 0.03, 0.05]), draw)) for k in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(made, words) == expected(rows, words)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd, 2) == expected(rows, 2)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SHELF", 7)
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**5)}" for _ in range(100)]
    # Texts that share most words with all others, and are above the threshold with few of them.
    rows = [(k, edited(" ".join(base), 0.06, draw)) for k in range(40)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(made, 2) == expected(rows, 2)


def test_empty_table(odd):
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_distance_loses_few_pairs_at_the_threshold():
    kept = sum(comb(minhash.SYMBOLS, k) * 0.2**k * 0.8 ** (minhash.SYMBOLS - k) for k in range(minhash.DISTANCE + 1))
    assert 1 - kept < 1e-4


def thue_morse(n):
    """A pattern and its complement, over which powers of any base cancel modulo 2^64."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)


def test_long_words_whose_powers_cancel_differ(spark):
    rows = list(enumerate([*thue_morse(2048), thue_morse(2048)[0], "x " + thue_morse(64)[0], "x " + thue_morse(64)[1]]))
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 2) == expected(rows, 2)
