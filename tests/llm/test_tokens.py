import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bins, packing
from tidemark.llm.tokens import Encoder

ENCODER = Encoder()
OTHER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab é漢1'!. \n\t\x1c\x85\xa0　st<|>", "<|endoftext|>", "<|endof"]), max_size=40).map("".join))
def test_ids_equal_those_of_the_other_library(text):
    assert ENCODER.encode(text).tolist() == OTHER.encode(text, add_special_tokens=False).ids


def expected_ids(rows):
    return [(r.doc_id, ENCODER.encode(r.text or "").tolist() + [0]) for r in rows]


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_pieces_hold_every_id_once_and_sequences_are_gapless(name, request):
    docs = request.getfixturevalue(name)
    rows = packing.pack(docs, ids=True).collect()
    whole, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        whole[r.doc_id].append((r.start, r.sequence_id, r.offset, ids.tolist(), r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 1024
    want = defaultdict(list)
    for doc_id, ids in expected_ids(docs.collect()):
        want[doc_id] += ids
        assert any(len(ids) == p[4] for p in whole[doc_id])
    for doc_id, ids in want.items():  # rows of one id: their ids together
        got = [x for p in sorted(whole[doc_id], key=lambda p: (p[1], p[2])) for x in p[3]]
        assert sorted(got) == sorted(ids)
        if len(ids) == whole[doc_id][0][4]:
            assert got == ids


def test_padding_is_little(docs):
    rows = packing.pack(docs.coalesce(1)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes.values())
    assert padding < 0.03 * sum(sizes.values())


def least_cost(ends, sentences, length):
    total, price = ends[-1], {p: packing.HARD for p in range(0, ends[-1], packing.GRID)}
    kept = {}
    for s in sentences:
        kept.setdefault(s // packing.CELL, s)
    price |= {s: packing.SENTENCE for s in kept.values()} | dict.fromkeys(ends, 0) | {0: 0}
    best = {0: 0}
    for p in sorted(price)[1:]:
        best[p] = price[p] + min(
            best[q] + (0 if p - q == packing.EXACT else length - (p - q)) for q in best if 0 < p - q <= length)
    return best[total]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=12), st.sets(st.integers(1, 3000), max_size=60))
def test_cuts_cost_the_least(lengths, sentences):
    ends = np.cumsum(lengths)
    sentences = sorted(s for s in sentences if s < ends[-1])
    at = packing.cuts(ends, np.array(sentences, np.int64), 1024)
    kept = {}
    for s in sentences:
        kept.setdefault(s // packing.CELL, s)
    price = lambda p: 0 if p in ends else packing.SENTENCE if p in kept.values() else packing.HARD
    cost = sum(price(p) + (0 if p - q == packing.EXACT else 1024 - (p - q)) for q, p in zip(at, at[1:]))
    assert cost == least_cost(ends.tolist(), sentences, 1024)


def test_every_sentence_end_can_be_a_cut():
    close = np.array([1009, 1012, 1023])  # the last of three ends in a row leaves 1 token of padding in all
    assert packing.cuts(np.array([2047]), close).tolist() == [0, 1023, 2047]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_is_that_of_a_plain_search(lengths):
    row_of, n = bins.best_fit(lengths, 64)
    free = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[i])
        else:
            free.append(64 - lengths[i])
    used = [0] * n
    for i, r in enumerate(row_of):
        used[r] += lengths[i]
    assert n == len(free) and sorted(64 - u for u in used) == sorted(free)


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_matrix_rows_hold_every_id_once(name, request):
    docs = request.getfixturevalue(name)
    got = defaultdict(list)
    for r in bins.packed_rows(docs).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == bins.LENGTH and r.cu_seqlens[-1] == r.n_tokens and r.ids_crc32 == zlib.crc32(r.ids)
        assert r.position_resets == r.cu_seqlens[:-1] and not ids[r.n_tokens:].any()
        for doc_id, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            got[doc_id].append((start, ids[a:b].tolist()))
    want = defaultdict(list)
    for doc_id, ids in expected_ids(docs.collect()):
        want[doc_id].append(ids)
    assert got.keys() == want.keys()
    for doc_id, texts in want.items():
        pieces = [x for _, p in sorted(got[doc_id]) for x in p]
        assert pieces == texts[0] if len(texts) == 1 else sorted(pieces) == sorted(sum(texts, []))


def test_the_special_token_is_one_id():
    assert ENCODER.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_written_rows_are_read_back_whole(spark, docs, tmp_path):
    rows = bins.packed_rows(docs)
    bins.write(rows, str(tmp_path / "bins"))
    again = sorted((bytes(r.ids), r.n_tokens, tuple(r.cu_seqlens)) for r in spark.read.parquet(str(tmp_path / "bins")).collect())
    assert again == sorted((bytes(r.ids), r.n_tokens, tuple(r.cu_seqlens)) for r in rows.collect())


def test_empty_tables(odd):
    assert packing.pack(odd.limit(0)).count() == 0 and bins.packed_rows(odd.limit(0)).count() == 0
