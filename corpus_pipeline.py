"""A training corpus from raw documents: reject bad and toxic ones, keep one of each group of near duplicates, remove what holds benchmark passages, redact
personal data, and encode. Each stage gets what its predecessor kept, written as Parquet and read again, and its decisions take effect.

Documents without words (null, empty or white space) are rejected by the first stage. Texts of any length are taken whole. Of repeated rows, which have one id, all or none stay, as their
texts decide; documents without an id are never near duplicates and stay if their texts may. Of equal documents the smallest id stays. Further columns, whatever their names, pass through all stages but the last.
An empty table gives an empty corpus; without labels the scorers learn from the labellers' posteriors, and without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import bpe, decontamination, jaccard_join, pii, quality_classifier
from latticework.llm.common import Scratch, free_name, table
from latticework.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free_name(docs.columns, "row")
    whole = docs.select(F.struct("*").alias(row), "text", "doc_id")
    scored = quality_classifier.classify(whole, table(spark, sf_dir, "labels"), keep=[row])
    return scored.where("accepted").select(f"{row}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary_path(), keep=["doc_id", "lang", "source", "n_chars"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact),
    ("bpe_encoding", encode),
]

#: Trained models, similarity joins over word shingles and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])  # its successor is written
    return STAGES[-1][1](spark, docs, sf_dir)
