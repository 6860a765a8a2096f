"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next stage's documents. All but the last return the columns of
``documents``. A table without rows goes through all stages and gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.llm import gray_copies, hd_langid, knn_quality, residual_packing, temperature_mix
from basketline.llm.common import free_name, held_out, table
from basketline.staging import stage

#: Votes for good quality that a document needs.
MIN_QUALITY = 0.3
#: Confidence in its language that a document needs.
MIN_CONFIDENCE = 0.4
#: Part of the largest entropy that sources are mixed to, and how often one may be repeated.
ENTROPY, REPEATS = 0.9, 2.0
#: Id behind each document, and tokens of a sequence.
END_ID, CAPACITY = 1, 4096


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    space = knn_quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return docs.where(knn_quality.score(space, docs) >= MIN_QUALITY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learned from the others."""
    known = hd_langid.prototypes(docs, ~held_out("doc_id", 4, 2))
    found = free_name(docs, "found")
    told = docs.withColumn(found, hd_langid.identify(known, docs))
    sure = (F.col(f"{found}.lang_pred") != hd_langid.UNKNOWN) & (F.col(f"{found}.score") >= MIN_CONFIDENCE)
    return told.where(sure).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of at least 0.8.

    Candidates come from the Gray-order index over five-word fingerprints; texts decide.
    """
    return gray_copies.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources repeated towards the target weights."""
    return temperature_mix.mix(docs, target_entropy=ENTROPY, max_repeats=REPEATS).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return residual_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, CAPACITY)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed),
]

#: The classifier's and the tokenizer's arithmetic has no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
