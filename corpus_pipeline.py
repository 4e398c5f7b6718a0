"""Corpus cleaning from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents.

Every stage keeps extra columns whatever their names, and repeated rows as the operators do; an empty table goes through
as an empty one. Null, empty and blank texts fail the quality rules, so they go in the first stage; very long texts are
worked on whole. Ties among near copies go to the smallest doc_id; rows without doc_id are never copies of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heartloom.llm import minhash, packing, pii, quality_gam, quality_rules
from heartloom.llm.common import cut, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_passing(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted good. The model is fitted on labelled raw documents, for the rules leave few bad ones."""
    model = quality_gam.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_gam.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies by five-word shingles; op6 alone takes two."""
    return minhash.keep_first(docs, minhash.NearParams(words=5))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced under the key in spark.heartloom.pii.key (a public one if it is unset, for tests)."""
    return pii.pseudonymise(docs, spark.conf.get("spark.heartloom.pii.key", "a key for tests"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_dedup), ("pii", surrogates), ("packing", sequences)]

#: Tokens, drawn surrogates and a fitted model can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = cut(docs)
    return docs
