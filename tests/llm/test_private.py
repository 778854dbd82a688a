import hashlib
import random
import re

import pytest

from tidemark.llm import private
from tidemark.session import written

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain(text):
    """Base spans by Python's own patterns."""
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), number, m.end()))
    return ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def card(rng, size=16):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(size - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def phone(rng):
    return f"+1 ({rng.randint(200, 989)}) 555-{rng.randint(1000, 9999)}"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def strange():
    rng = random.Random(3)
    pieces = ["a", "Z", "1", "25", "256", "4111111111111111", "@", ".", "..", "-", "+", "+1", " ", "  ", "(", ")", "_",
              "é", "😀", "\n", "b@c.d", "1.2.3.4", "0004.3.2.1", "x_", "%", "+44 20 7946 0958"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    out += ["1" * 4000, "a." * 2000, "+1" + " " * 20_000, "1 " * 20_000, "a@b" * 2000, "9" * 4000 + ".1.1.1"]
    return out + ["b@c.d " * 3000, "😀1.2.3.4é" * 700]


def listed(rows):
    return rows.select("doc_id", private.named("base").alias("base"), private.named("spans").alias("spans"),
                       "key").collect()


def test_base_spans_are_those_of_the_patterns(spark, docs, odd):
    texts = [(i, t) for i, t in enumerate(strange())]
    made = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.base for r in listed(private.find(private.searched(made), private.Judge()))}
    assert found == {i: plain(t) for i, t in texts}
    given = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    due = sorted((r.doc_id or -1, plain(r.text)) for r in given.collect())
    out = listed(private.find(private.searched(given), private.Judge()))
    assert sorted((r.doc_id or -1, r.base) for r in out) == due
    assert all(r.spans == r.base for r in out)


@pytest.fixture(scope="module")
def corpus(spark):
    """Findings among words and among numbers that are none, and pairs of findings run into one."""
    rng, rows, hidden = random.Random(8), [], {}
    for i in range(1200):
        kind = i % 6
        number = "".join(rng.choice("0123456789") for _ in range(16))
        one = [card(rng), phone(rng), f"{words(rng, 1)}.{i}@mail{i % 7}.example.com",
               f"{rng.randint(1, 254)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)}",
               number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10), words(rng, 2)][kind]
        rows.append((i, f"{words(rng, 12)} {one} {words(rng, 9)}", "x"))
    for i in range(1200, 1260):
        first, second, before = (phone(rng), card(rng), words(rng, 7)) if i % 2 else (card(rng), card(rng), words(rng, 3))
        rows.append((i, f"{before} {first} {second} {words(rng, 5)}", "x"))
        a = len(before) + 1
        hidden[i] = {(a, a + len(first)), (a + len(first) + 1, a + len(first) + 1 + len(second))}
    return spark.createDataFrame(rows, "doc_id long, text string, spans string"), hidden


def parts(spans):
    return {tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s}


def test_trees_find_what_runs_together_and_little_else(spark, corpus):
    docs, hidden = corpus
    out = listed(private.personal_data(docs.repartition(4)))
    added = {r.doc_id: parts(r.spans) - parts(r.base) for r in out}
    assert all(parts(r.base) <= parts(r.spans) for r in out)
    found = sum(len(added[i] & spans) for i, spans in hidden.items())
    due = sum(map(len, hidden.values()))
    assert found >= 0.9 * due
    wrong = sum(len(s - hidden.get(i, set())) for i, s in added.items())
    assert wrong <= 0.05 * due


def test_redaction(spark, corpus):
    docs, hidden = corpus
    found = written(private.personal_data(docs), "found")
    masked = private.redact(docs, found)
    assert masked.columns == docs.columns
    spans = {r.doc_id: r.spans for r in listed(found)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in masked.collect():
        text = texts[r.doc_id]
        for s in reversed([s for s in spans[r.doc_id].split(",") if s]):
            kind, a, b = s.split(":")
            text = text[:int(a)] + f"[{kind.upper()}]" + text[int(b):]
        assert r.text == text


def test_overlapping_spans_become_one_mask(spark):
    docs = spark.createDataFrame([(1, "call +1 2 3.4.5.6 78 90 12 now 1.2.3.4")], "doc_id long, text string")
    found = private.find(private.searched(docs), private.Judge())
    (row,) = listed(found)
    assert row.base == plain("call +1 2 3.4.5.6 78 90 12 now 1.2.3.4")
    (masked,) = private.redact(docs, found).collect()
    assert masked.text.count("[PHONE]") == 1 and masked.text.endswith("now [IP]")


def test_labelled_findings_replace_the_base(spark, corpus):
    docs, _ = corpus
    proposed = written(private.candidates(private.searched(docs)), "candidates")
    told = proposed.selectExpr(
        "doc_id", "element_at(array('email', 'ip', 'card', 'phone'), kind + 1) AS kind", "start", "end",
        "kind = 2 AND label IS NOT NULL AS label")
    assert set(private.train(proposed, told).thresholds) <= {"card"}


def test_query_digest_and_rows(spark, docs, odd):
    given = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    out = private.digests(private.personal_data(given)).collect()
    due = sorted((r.doc_id or -1, hashlib.sha256(plain(r.text).encode()).hexdigest()) for r in given.collect())
    assert sorted((r.doc_id or -1, r.base_sha256) for r in out) == due


def test_query_counts_spans_by_kind(spark):
    card_number = "4111111111111111"
    texts = [None, "", "none", "a@b.c", "1.2.3.4 5.6.7.8", f"{card_number}; {card_number}", "+44 20 7946 0958", f"{card_number}, a@b.c",
             f"1.2.3.4, a@b.c, +44 20 7946 0958, d@e.f, {card_number}"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = private.digests(private.find(private.searched(made), private.Judge())).collect()
    found = {r.doc_id: [r[f"n_{k}"] for k in private.KINDS] for r in out}
    kinds = [[s.split(":")[0] for s in plain(t).split(",")] for t in texts]
    assert found == {i: [k.count(name) for name in private.KINDS] for i, k in enumerate(kinds)}
    assert found[len(texts) - 1] == [2, 1, 1, 1]


def test_empty(docs):
    assert private.personal_data(docs.limit(0)).count() == 0
