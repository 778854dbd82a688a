import hashlib
import re
from functools import partial

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import fim


def plain_form(doc_id, text, seed="1"):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(doc_id, text, cache):
    data = text.encode()
    *head, output = fim.rearranged(doc_id, data, cache)
    assert (*head, output.decode()) == plain_form(doc_id, text)
    assert fim.restored(output, head[1]) == data


def test_all_documents_match_a_plain_tokenizer(spark, docs):
    found = {r.doc_id: r for r in fim.fill_in_middle(docs).collect()}
    for r in docs.collect():
        f = found[r.doc_id]
        assert (f.n, f.form, f.prefix_chars, f.middle_chars, f.output) == plain_form(r.doc_id, r.text)
    assert {f.form for f in found.values()} == {"plain", "psm", "spm"}


def test_query_digests(spark, docs):
    outputs = {r.doc_id: r.output for r in fim.fill_in_middle(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in fim.fill_in_middle(docs, digests=True).collect():
        assert (r.output_sha256, r.restored_sha256) == (sha(outputs[r.doc_id]), sha(texts[r.doc_id]))


@settings(max_examples=150, deadline=None)
@given(st.integers(-5, 300), st.text(st.sampled_from("ab Zé漢😀<SPM>\n9"), max_size=200))
def test_any_text(doc_id, text):
    check(doc_id, text, fim.Cache())


def test_cuts_anywhere_in_long_texts(monkeypatch):
    monkeypatch.setattr(fim, "CHUNK_BITS", 5)
    monkeypatch.setattr(fim, "LONGEST", 100)
    words = "word é 漢字 another, longwordwithoutend 😀! " * 40
    for text in (words, "x" * 5000, "é" * 3000, "😀" * 900, " " * 2000, words + "y" * 700 + words):
        data, cache = text.encode(), fim.Cache()
        chunked = fim.Chunked(data, cache)
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert chunked.tokens == len(tokens) and b"".join(
            data[a:b] for a, b in zip(chunked.starts, chunked.ends)) == data
        assert max(b - a for a, b in zip(chunked.starts, chunked.ends)) <= 103
        for units in range(0, len(tokens) + 1, 7):
            before = "".join(tokens[:units])
            assert chunked.cut(units) == (len(before.encode()), len(before))


def test_chunks_follow_content_and_are_summarised_once():
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh .,"), 40_000))
    cache = fim.Cache()
    one = fim.Chunked(shared.encode(), cache)
    met = cache.found
    fim.Chunked(("an opening of its own " + shared).encode(), cache)
    assert cache.found - met >= 0.9 * len(one.ends)


def test_a_small_cache_changes_nothing():
    text = "".join(f"piece {i} of the text. " for i in range(4000))
    small, large = partial(fim.Cache, 3000), fim.Cache
    for kind in (small, large):
        check(3, text, kind())
    cache = small()
    fim.Chunked(text.encode(), cache)
    assert cache.held <= 3000


def test_odd_rows(spark, odd):
    found = sorted(map(repr, fim.fill_in_middle(odd).collect()))
    from pyspark.sql import Row

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    due = [Row(**dict(zip(names, (r.doc_id, *plain_form(r.doc_id, r.text))))) for r in odd.collect()]
    assert found == sorted(map(repr, due))
    assert fim.fill_in_middle(odd.limit(0)).count() == 0
