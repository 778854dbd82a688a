import base64
from decimal import Decimal

import pytest
from helpers import encoded
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.decimals import connect_decimal

LIMIT = 10**38 - 1
EDGES = [0, 1, -1, 127, 128, -128, -129, 1000, -1000, 2**63 - 1, -(2**63), 2**63, -(2**63) - 1,
         2**64, -(2**64), 2**64 - 1, -(2**64) + 1, LIMIT, -LIMIT]


def decode(spark, texts, precision, scale):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", connect_decimal(F.col("t"), precision, scale).alias("d")).orderBy("i")
    return [r.d for r in out.collect()]


@pytest.mark.parametrize("text, unscaled", [
    ("fw==", 127), ("AIA=", 128), ("AA==", 0), ("/w==", -1), ("gA==", -128), ("/38=", -129),
    ("A+g=", 1000), ("/Bg=", -1000), ("f/////////8=", 2**63 - 1), ("gAAAAAAAAAA=", -(2**63))])
def test_known_encodings(spark, text, unscaled):
    assert encoded(unscaled) == text
    assert decode(spark, [text], 38, 0) == [Decimal(unscaled)]


def test_wide_edges(spark):
    assert decode(spark, [encoded(v) for v in EDGES], 38, 0) == [Decimal(v) for v in EDGES]


def test_out_of_range_and_unreadable_give_null(spark):
    texts = [encoded(10**38), encoded(-(10**38)), None, "", "!!!", "A"]
    assert decode(spark, texts, 38, 0) == [None] * 6
    assert decode(spark, [encoded(10**10), encoded(-(10**10)), encoded(2**70), "", "?"], 10, 2) \
        == [None] * 5


def test_sign_padding_beyond_eight_bytes_is_accepted(spark):
    padded = [base64.b64encode(v.to_bytes(n, "big", signed=True)).decode()
              for v in (5, -5, 2**31, -(2**31)) for n in (8, 9, 12)]
    expected = [Decimal(v).scaleb(-2) for v in (5, -5, 2**31, -(2**31)) for _ in range(3)]
    assert decode(spark, padded, 10, 2) == [None if abs(d) >= 10**8 else d for d in expected]


def test_large_scale_is_exact(spark):
    assert decode(spark, [encoded(-12345678901234567890)], 38, 10) \
        == [Decimal("-1234567890.1234567890")]
    assert decode(spark, [encoded(123456789012345678)], 18, 12) == [Decimal("123456.789012345678")]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-LIMIT, LIMIT), min_size=50, max_size=200),
       st.lists(st.integers(-(10**10) + 1, 10**10 - 1), min_size=50, max_size=200))
def test_round_trip(spark, wide, narrow):
    assert decode(spark, [encoded(v) for v in wide], 38, 2) == [Decimal(v).scaleb(-2, _ctx()) for v in wide]
    assert decode(spark, [encoded(v) for v in narrow], 10, 2) == [Decimal(v).scaleb(-2) for v in narrow]


def _ctx():
    from decimal import Context
    return Context(prec=60)
