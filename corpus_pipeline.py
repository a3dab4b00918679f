"""Corpus pipeline: quality, near copies, benchmark leaks, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``docs``, whatever they are besides ``doc_id`` and ``text``. Null and empty texts
are scored as empty; of them one stays, if the classifier keeps it. Null ids, repeated rows and
empty tables pass through; of repeated rows one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm import bpe, decontaminate, pii, quality_model, simhash
from ionweave.llm.common import fresh_folder, held_out, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality_model.keep_good(docs, *quality_model.train(docs, table(spark, sf_dir, "labels").where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in place of personal data and secrets."""
    return pii.replace_in(docs, pii.checked_key(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, decoded, n_tokens``: each document's token ids and the text they stand for."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.code(docs, vocabulary)
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: A trained network and a search by similarity are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        folder = fresh_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
