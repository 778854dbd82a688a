import random

from tidemark.llm import language


def phrases(text, sample):
    """Phrase ends of a greedy parse: a phrase ends where the sample no longer continues it."""
    ends, a = 0, 0
    for b in range(1, len(text) + 1):
        if text[a:b] not in sample:
            ends += 1
            a = b - 1
            if text[a:b] not in sample:
                a = b
    return ends


def test_automaton_against_brute_force():
    draw = random.Random(1)
    sample = [draw.randrange(1, 4) for _ in range(300)]
    automaton = language.Automaton(sample, 5)
    import numpy as np

    for n in (1, 10, 200):
        text = [draw.choice([1, 2, 3, 3, 4]) for _ in range(n)]
        steps = np.array(text, np.int32)[:, None]
        assert automaton.phrases(steps, [1] * n)[0] == phrases(bytes(text), bytes(sample))


def test_costs_do_not_depend_on_neighbours():
    model = language.Model({"a": "the cat sat on the mat " * 20, "b": "der hund lief in den wald " * 20})
    texts = [b"the cat", b"der wald der hund " * 300, b"on the mat the cat sat"]
    together = model.costs(texts)
    for text, row in zip(texts, together):
        assert abs(model.costs([text])[0] - row).max() < 1e-9
    assert together.argmin(1).tolist() == [0, 1, 0]


def test_held_out_accuracy(docs):
    found = language.identify(docs, language.train(docs.where(~language.held_out()))).join(
        docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 30 and right >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows_and_empty_tables(odd, docs):
    model = language.train(docs)
    found = language.identify(odd, model)
    assert found.count() == odd.count()
    assert {r.doc_id for r in found.where("lang_pred = 'und'").collect()} == {0, 1, 2, 12}
    assert language.identify(odd.limit(0), model).count() == 0
    assert language.train(odd.where("lang is null")) is None
    assert language.identify(odd, None).where("lang_pred <> 'und'").count() == 0
