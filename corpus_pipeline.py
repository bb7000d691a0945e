"""A corpus from raw documents: quality, near-duplicates, personal data, packing.

Every stage works on all that the one before it kept. Stages write nothing but what their
operators settle in the shared folder; run() writes each stage's rows there, reads them back, and
deletes what only that stage needed.

In every stage a null or empty text is a text without words, rows may repeat, ids may be null, other
columns pass through untouched, and an empty table stays empty; very long texts are worked on in parts
or in memory that grows with the one text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import minhash, packing, pii, quality, storage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5; the model learns from the labels of documents that are still there.

    Equal texts have equal scores; a text without words has the score of no words. Without labels all stay.
    """
    return quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more: the one with the smallest id.

    Texts without words resemble nothing and stay. Of rows with one id one stays; rows without id stay all.
    """
    return minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data; null texts stay null."""
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: doc_id, piece, start, length, ids, sequence_id, offset.

    A null or empty text is one piece with the end id; repeated rows give their pieces again.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), added=True)


STAGES = [("quality_classifier", quality_classifier), ("minhash_near_dedup", minhash_near_dedup), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

#: None of the four stages can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES:
        docs = storage.alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        storage.forget(last)
        last = docs
    return docs
