"""Queries against their SQL, and what the others promise on the supplied tables."""

import pytest
from compare import compare, connection

import __spark_entry__ as entry
from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, connection(sf), name, sf) is None


def test_all_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


CONTRACT = {
    "op3_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "base_failed", "kept"],
    "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op11_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_columns_and_rows(spark, sf, docs, name):
    out = entry.queries()[name](spark, sf)
    assert set(CONTRACT[name]) <= set(out.columns)
    assert out.select("doc_id").distinct().count() == docs.count()
