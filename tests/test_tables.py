import pytest
from pyspark.errors import AnalysisException

from tidemark.session import configure, scratch, shared_folder, written
from tidemark.sources import tables


def test_create_insert_select_drop(spark, tmp_path):
    rows = spark.range(5, 0, -1).selectExpr("id * id AS id", "concat('n', id) AS label")
    tables.create_table(spark, "smoke", rows.schema, str(tmp_path / "smoke"))
    tables.create_table(spark, "smoke", rows.schema, str(tmp_path / "smoke"))  # exists: no error
    try:
        tables.insert_rows(rows, "smoke")
        tables.insert_rows(rows.where("id > 9"), "smoke")  # a second load appends
        loaded = spark.table("smoke").groupBy("label").count().orderBy("label").collect()
        assert {r.label: r["count"] for r in loaded} == {"n1": 1, "n2": 1, "n3": 1, "n4": 2, "n5": 2}
    finally:
        tables.drop_table(spark, "smoke")
    with pytest.raises(AnalysisException):
        spark.table("smoke")


def test_namespace_listing(spark, tmp_path):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS listing")
    tables.create_table(spark, "listing.one", spark.range(1).schema, str(tmp_path / "one"))
    assert [r.tableName for r in tables.tables_in(spark, "listing").collect()] == ["one"]
    assert tables.describe_namespace(spark, "listing").count() > 0
    tables.drop_table(spark, "listing.one")


def test_overwrite_and_read_back(spark, tmp_path):
    path = str(tmp_path / "t")
    for text in ("first", "second"):
        spark.createDataFrame([(text,)], "message string").write.mode("overwrite").parquet(path)
    assert [r.message for r in spark.read.parquet(path).collect()] == ["second"]


def test_written_results_live_in_the_shared_folder(spark):
    df = written(spark.range(3), "numbers")
    assert df.count() == 3
    assert shared_folder(spark) in df.inputFiles()[0].replace("file://", "")
    assert scratch(spark, "x") != scratch(spark, "x")


def test_configure_sets_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    assert configure(spark).conf.get("spark.sql.session.timeZone") == "UTC"


def test_dropping_a_managed_table_removes_its_files(spark):
    rows = spark.createDataFrame([(1, "a")], "id bigint, description string")
    tables.create_table(spark, "managed_smoke", rows.schema)
    tables.insert_rows(rows, "managed_smoke")
    (path,) = {f.rsplit("/", 1)[0] for f in spark.table("managed_smoke").inputFiles()}
    tables.drop_table(spark, "managed_smoke")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
