"""A corpus pipeline: quality, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), gets the table that the stage before it wrote, and all but the last return the
columns of ``documents``. Rejected are the documents that score below 0.3 and all but one row of a group of near-duplicates
(5-word shingle sets of Jaccard similarity 0.8 or more), which is the one with the smallest doc_id; the mixture repeats documents of small
sources and leaves none out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import mixing, packing, pii, quality, simhash
from quillstone.llm.queries import CONTEXT_SHARE, END_ID, MAX_LOSS, MAX_REPEATS, pii_key, trained_quality_model, vocabulary
from quillstone.llm.store import clear, mark, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = trained_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.quality_score(docs, weights) >= 0.3)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_similar(docs, words=5, similarity=0.8)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii_key(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, max_repeats=MAX_REPEATS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary(), END_ID, context_share=CONTEXT_SHARE, max_loss=MAX_LOSS)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("PII pseudonyms", pii_stage),
    ("temperature mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier's training, the fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet to the shared folder and read back. When a stage is written, its
    own tables and what the stage before wrote are deleted."""
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES:
        at = shared_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(at)
        clear(spark, began, keep=(at,))
        docs = spark.read.parquet(at)
    return docs
