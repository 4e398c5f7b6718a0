"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heartloom.llm import byte_bpe, fill_middle, html_text, license_scan, matroska, minhash, packing, pii, quality_gam, quality_rules, url_rules, vector_codes, warc
from heartloom.llm.common import table


#: Key of the surrogates where none is set in spark.heartloom.pii.key; for tests and checks only, as it is public.
TEST_KEY = "a key for tests"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.heartloom.pii.key", TEST_KEY)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii_key(spark))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.classify(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.round_trip(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_pii_surrogates, op2_quality_rules, op3_license_scan, op4_byte_bpe, op5_quality_classifier, op6_minhash_near_dedup, op7_matroska, op8_html_text, op9_packing, op10_url_rules,
        op11_warc_archive, op12_fill_middle, op13_vector_codes,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.ORACLE, "op6_minhash_near_dedup": minhash.ORACLE, "op11_warc_archive": warc.ORACLE, "op12_fill_middle": fill_middle.ORACLE,
        "op13_vector_codes": vector_codes.ORACLE,
    }
