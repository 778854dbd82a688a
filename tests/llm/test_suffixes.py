import hashlib
import random

import pytest

from tidemark.llm import suffixes


def expected(rows):
    out = []
    for i, text in rows:
        data = (text or "").encode()
        smaller = [(t or "").encode() for j, t in rows if i is not None and j is not None and j < i]
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if any(data[k:k + 50] in other for other in smaller):
                gone[k:k + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    return sorted((tuple(r)[:5] for r in suffixes.repeated_strings(docs).collect()), key=str)


def passages(seed):
    draw = random.Random(seed)
    letters = "abcdeé "
    shared = ["".join(draw.choice(letters) for _ in range(n)) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(40):
        parts = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 90))) for _ in range(4)]
        for s in draw.sample(shared, 2):
            a = draw.randrange(0, 20)
            parts.insert(draw.randrange(4), s[a:] if draw.random() < 0.5 else s)
        rows.append((draw.randrange(30), "".join(parts)))
    return rows + [(50, "ab" * 200), (51, "ab" * 100), (52, "b" + "ab" * 30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", 700)
    monkeypatch.setattr(suffixes, "SHARD_CHARS", 2000)
    rows = passages(seed)
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(made) == expected(rows)


def test_odd_rows(odd):
    assert result(odd) == expected([(r.doc_id, r.text) for r in odd.collect()])


def test_spans_are_what_is_removed(docs):
    for r in suffixes.repeated_strings(docs).where("n_spans > 0").collect():
        assert len(r.span_starts) == len(r.span_ends) == r.n_spans
        assert sum(b - a for a, b in zip(r.span_starts, r.span_ends)) == r.n_removed
        assert all(b - a >= 50 for a, b in zip(r.span_starts, r.span_ends))


def test_empty_table(odd):
    assert suffixes.repeated_strings(odd.limit(0)).count() == 0


def test_every_difference_of_places_occurs_in_the_cover():
    cover, period = suffixes.COVER, suffixes.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def thue_morse(n):
    """A pattern and its complement, over which powers of any base cancel modulo 2^64."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)


def test_texts_whose_powers_cancel_are_no_copies(spark):
    rng = random.Random(2)
    base = [rng.choice("cdefghij") for _ in range(2048)]
    texts = ["".join(chr(ord(c) + (x == "a")) for c, x in zip(base, signs)) for signs in thue_morse(2048)]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[0])]
    found = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == expected(rows)
