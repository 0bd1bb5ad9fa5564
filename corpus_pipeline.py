"""The corpus pipeline: documents to packed training sequences.

Four stages, in this order: the quality classifier drops documents it rejects; near-dedup keeps one
document of each group of near copies; secret scanning masks the secrets it reports; best-fit packing
cuts what is left into sequences of 2048 tokens. Every stage works on all that its predecessor
kept. The first three return the columns of ``documents``; the last returns a row for each piece.

Defined cases follow the operators'. Rows that repeat both doc_id and text count as copies of one
document; rows that repeat a doc_id with other texts are dropped or kept by their own texts; rows
without a doc_id are never dropped as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexora.llm.near_dedup import without_copies
from lexora.llm.packing import pack_documents
from lexora.llm.quality import keep_quality
from lexora.llm.secrets import redact_secrets
from lexora.session import cut, forget


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, at a similarity of 0.8."""
    kept = without_copies(docs, percent=80)
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
    return kept


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in them masked."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and tokenisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the whole of ``documents``; each stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        made = stage(spark, docs, sf_dir)
        if n == len(STAGES):
            return made
        written = cut(made)
        forget(docs)
        docs = written
    return docs
