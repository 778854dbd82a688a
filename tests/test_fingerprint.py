from helpers import raw_frame
from pyspark.sql import functions as F

from tidemark.operators import fingerprint as prints
from tidemark.schemas import IDENTITY


def identities(spark, count, step=1):
    return spark.range(0, count, 1, 4).select(
        F.concat(F.lit("t"), F.col("id") % 2).alias("topic"),
        (F.col("id") % 5).cast("int").alias("kafka_partition"),
        (F.col("id") * step).alias("offset"))


def test_hash_sum_equals_the_sum_of_decimals(spark):
    df = identities(spark, 20000)
    direct = df.groupBy("topic", "kafka_partition").agg(
        F.sum(F.xxhash64(*IDENTITY).cast("decimal(38,0)")).alias("expected"))
    both = prints.fingerprint(df).join(direct, ["topic", "kafka_partition"])
    assert both.count() == 10
    assert both.where("hash_sum <> expected or row_count <> 2000").count() == 0


def test_equal_sets_have_no_difference(spark):
    df = identities(spark, 500)
    other = df.orderBy(F.desc("offset")).repartition(7)
    assert prints.difference(prints.fingerprint(df), prints.fingerprint(other)).count() == 0


def test_lost_doubled_and_moved_records_are_found(spark):
    df = identities(spark, 500)
    whole = prints.fingerprint(df)
    lost = df.where("offset <> 250")
    doubled = df.unionByName(df.where("offset = 250"))
    # same count and same range: only the hash can tell
    moved = lost.unionByName(df.where("offset = 240"))
    gone = df.where("topic = 't0'")
    for changed, groups in ((lost, 1), (doubled, 1), (moved, 1), (gone, 5)):
        assert prints.difference(whole, prints.fingerprint(changed)).count() == groups


def test_payload_mode_finds_changed_bytes(spark):
    left = raw_frame(spark, ["a", "b", None])
    right = raw_frame(spark, ["a", "c", None])

    def differs(**mode):
        return prints.difference(prints.fingerprint(left, **mode),
                                 prints.fingerprint(right, **mode)).count()

    assert differs() == 0
    assert differs(payload=True) == 1


def test_only_identity_columns_are_read(spark, tmp_path):
    raw_frame(spark, ["a"]).write.parquet(str(tmp_path / "raw"))
    plan = prints.fingerprint(spark.read.parquet(str(tmp_path / "raw")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<topic:string,kafka_partition:int,offset:bigint>" in text
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_duplicates(spark):
    df = identities(spark, 10).unionByName(identities(spark, 3))
    assert sorted((r.offset, r.copies) for r in prints.duplicates(df).collect()) \
        == [(0, 2), (1, 2), (2, 2)]
