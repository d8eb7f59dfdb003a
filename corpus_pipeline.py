"""The corpus pipeline: five stages, each on all that its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from kgloom.llm.common import small_batches, stage, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, trained on the labelled rows, scores one half or more."""
    small_batches(spark)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model, least=0.5).drop(quality_classifier.SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that match an earlier one, short ones too; lines without words stay."""
    return line_dedup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Five-word shingles and a similarity of 0.8. Documents without words are in no group and stay.
    Rows that repeat one doc_id are one document: they stay or go together.
    """
    small_batches(spark)
    of = ngram_join.near_duplicates(docs, width=5, num=80, den=100).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(of, docs["doc_id"].eqNullSafe(of["kept_id"]), "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's rate says."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Training and retrieval have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
