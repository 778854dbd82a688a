"""From raw documents to packed training sequences, a stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and
reads it again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kneser, minhash, mixing, packing, secrets
from tidemark.llm.tables import fresh, table, without
from tidemark.session import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model does not reject."""
    judged = kneser.classify(docs, table(spark, sf_dir, "labels"))
    rejected = judged.where(~F.col("kept")).select("doc_id", "tie").distinct()
    return without(docs, rejected, {"tie": F.xxhash64("text")})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (runs of five words, similarity 0.8): the smallest id,
    an id before none. Of repeated rows that are left, the first by its other columns stays."""
    found = written(minhash.survivors(docs, words=5), "survivors")
    key = {"row": minhash.row_key()}
    left = without(docs, found.where("not kept").select("row"), key)
    (row,) = fresh(docs, "row")
    repeated = found.where("kept and n > 1").select(F.col("row").alias(row))
    if repeated.isEmpty():
        return left
    again = left.join(repeated, minhash.row_key() == F.col(row), "left_semi")
    first = again.groupBy(minhash.row_key().alias("of")).agg(F.min(F.struct(*docs.columns)).alias("first"))
    return without(left, repeated.withColumnRenamed(row, "row"), key).unionByName(first.select("first.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and ``n_chars`` brought up to date."""
    masked = secrets.redact(docs, secrets.train(docs))
    if "n_chars" in docs.columns:
        length = F.coalesce(F.length("text"), F.col("n_chars"))
        masked = masked.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return masked


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sequences", sequences),
]

# The n-gram model, the forest and the tokens have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
