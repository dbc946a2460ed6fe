"""Corpus pipeline: quality classifier, near-duplicate removal, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. Stages handle null and empty texts, repeated rows and empty tables
as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm import mixing, near_dedup, packing, pii, quality
from strandwise.llm.shared import stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely above the lowest grade than not; taught by the labels of documents still here."""
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies: 80 % of their shingles alike."""
    return near_dedup.deduplicated(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents, or parts at block borders, as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in pieces of at most one sequence, each with its sequence and place there."""
    cut = stage(packing.pieces(docs.select("doc_id", "text")), "pieces")
    return packing.packed(cut, key=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: fitted models, signatures, EM and a tokenizer's ids are beyond it. tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is staged in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
