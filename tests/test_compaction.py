import pytest

from tidemark.operators.compaction import Thresholds, policy

MB = 1024 * 1024


@pytest.mark.parametrize("sizes, expected, operation", [
    ([1 * MB] * 4, 1, "NO_NEED"),                # too few small files
    ([1 * MB] * 5, 1, "DO_COMPACTION"),          # five small files for one
    ([97 * MB] * 8, 7, "NO_NEED"),               # no file is small
    ([32 * MB] * 16, 4, "DO_COMPACTION"),        # ratio exactly four
    ([33 * MB] * 16, 5, "NO_NEED"),              # ratio below four
    ([128 * MB], 1, "NO_NEED"),
    ([128 * MB + 1], 2, "NO_NEED"),
    ([96 * MB - 1] * 5 + [1] * 15, 4, "DO_COMPACTION"),
    ([0] * 5, 1, "DO_COMPACTION"),
])
def test_policy(spark, sizes, expected, operation):
    layout = spark.createDataFrame([("d", s) for s in sizes], "day string, file_bytes bigint")
    (row,) = policy(layout, by=("day",)).collect()
    assert (row.input_files, row.input_bytes) == (len(sizes), sum(sizes))
    assert (row.expected_files, row.operation) == (expected, operation)
    assert row.fragmentation_ratio == len(sizes) / expected


def test_all_dates_in_one_pass(spark):
    layout = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)], "day string, file_bytes bigint")
    assert {r.day: r.operation for r in policy(layout, by=("day",)).collect()} \
        == {"a": "DO_COMPACTION", "b": "NO_NEED"}


def test_own_thresholds(spark):
    layout = spark.createDataFrame([("a", 10)] * 3, "day string, file_bytes bigint")
    limits = Thresholds(target_bytes=10, small_bytes=11, min_small_files=3, fragmentation=1)
    (row,) = policy(layout, by=("day",), limits=limits).collect()
    assert (row.expected_files, row.operation) == (3, "DO_COMPACTION")


def test_sizes_beyond_the_precision_of_doubles(spark):
    layout = spark.createDataFrame([("a", 2**60 + 1)], "day string, file_bytes bigint")
    (row,) = policy(layout, by=("day",)).collect()
    assert row.expected_files == 2**60 // (128 * MB) + 1
