"""One query per operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    bins,
    fim,
    kneser,
    language,
    minhash,
    mixing,
    packing,
    private,
    repair,
    rules,
    secrets,
    suffixes,
    vectors,
)
from tidemark.llm.oracle import ORACLE
from tidemark.llm.tables import table
from tidemark.session import written

__all__ = ["ORACLE", "QUERIES"]


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(rules.measure(table(spark, sf_dir, "documents")), "rules")
    cutoffs = rules.calibrate(measured, table(spark, sf_dir, "labels"))
    return rules.judge(measured, cutoffs)


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op5_token_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.packed_rows(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs.where(~language.held_out())))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_strings(table(spark, sf_dir, "documents"))
    return found.drop("span_starts", "span_ends")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digests(private.personal_data(table(spark, sf_dir, "documents")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.with_digests(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"), digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vectors": op1_vectors,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_packing": op3_packing,
    "op4_minhash": op4_minhash,
    "op5_token_bins": op5_token_bins,
    "op6_secrets": op6_secrets,
    "op7_quality_rules": op7_quality_rules,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_suffixes": op10_suffixes,
    "op11_pii": op11_pii,
    "op12_repair": op12_repair,
    "op13_fim": op13_fim,
}
