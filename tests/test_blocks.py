import pytest

from tidemark.operators import blocks, quality
from tidemark.schemas import ORDERS

BITS = 4


def layer(spark, count=4000, drop=(), twice=()):
    rows = spark.range(count).selectExpr(f"'{ORDERS.topic}' AS topic", "CAST(id % 3 AS INT) AS kafka_partition", "id div 3 AS offset")
    key = "kafka_partition * 100000 + offset"
    kept = rows.where(f"{key} NOT IN ({', '.join(map(str, drop)) or -1})")
    return kept.unionByName(kept.where(f"{key} IN ({', '.join(map(str, twice)) or -1})"))


def found(left, right):
    trees = [blocks.tree(blocks.leaves(x, BITS)) for x in (left, right)]
    return blocks.differing(*trees)


def test_only_differing_blocks_are_listed(spark):
    got = found(layer(spark), layer(spark, drop=(5, 100_250), twice=(200_600,)))
    assert {(r.kafka_partition, r.block, r.input_rows - r.output_rows) for r in got.collect()} == {
        (0, 0, 1), (1, 15, 1), (2, 37, -1)}
    assert found(layer(spark), layer(spark)).count() == 0


def test_same_count_other_rows(spark):
    """A record lost and another one twice in one block: the hash tells."""
    got = found(layer(spark), layer(spark, drop=(33,), twice=(34,)))
    assert [(r.kafka_partition, r.block, r.input_rows, r.output_rows) for r in got.collect()] == [(0, 2, 16, 16)]


def test_a_side_without_a_topic(spark):
    got = found(layer(spark, 40), layer(spark, 40).where("kafka_partition <> 1"))
    assert {(r.kafka_partition, r.output_rows) for r in got.collect()} == {(1, 0)}
    assert found(layer(spark, 0), layer(spark, 0)).count() == 0


def test_trees_are_stored_and_summed(spark, tmp_path):
    whole = layer(spark)
    first, second = whole.where("offset < 700"), whole.where("offset >= 700")
    for name, part in (("a", first), ("b", second)):
        blocks.keep(blocks.tree(blocks.leaves(part, BITS)), str(tmp_path / name))
    together = blocks.merged([blocks.kept(spark, str(tmp_path / n)) for n in ("a", "b")])
    assert blocks.differing(together, blocks.tree(blocks.leaves(whole, BITS))).count() == 0


def scanned(df):
    """Rows that the file scan of ``df`` handed on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.mark.parametrize("limit", [64, 2])
def test_equal_blocks_are_not_read(spark, tmp_path, limit):
    path = str(tmp_path / "layer")
    (layer(spark, 60_000).repartitionByRange(20, "kafka_partition", "offset").sortWithinPartitions("kafka_partition", "offset")
     .write.option("parquet.block.size", 4096).parquet(path))
    stored = spark.read.parquet(path)
    wanted = found(stored, layer(spark, 60_000, drop=(100_250,)))
    condition = blocks._ranges(wanted, BITS, limit)
    near = stored.where(condition)
    assert scanned(near) <= 60_000 / 10  # one file of twenty
    got = blocks.opened(stored, wanted, BITS, limit)
    assert {(r.kafka_partition, r.offset) for r in got.collect()} == {(1, o) for o in range(240, 256)}


def test_more_places_than_ranges(spark):
    wide = layer(spark, drop=range(0, 1300, 40))
    wanted = found(layer(spark), wide)
    assert wanted.count() > 20
    for limit in (64, 5, 1, 0):  # with 0 not even one range is left
        got = quality.reconcile(blocks.opened(layer(spark), wanted, BITS, limit), blocks.opened(wide, wanted, BITS, limit))
        assert {(r.offset, r.verdict) for r in got.collect()} == {(o, "lost") for o in range(0, 1300, 40)}
