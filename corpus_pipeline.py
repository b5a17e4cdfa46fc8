"""From raw documents to token ids: quality rules, line dedup, near-duplicates, decontamination, SentencePiece.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfsight.llm import decontamination, line_dedup, ngram_join, quality, subwords
from shelfsight.llm.queries import MODEL
from shelfsight.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the adaptive cutoffs go."""
    return quality.kept_only(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go, but for their first copy; a document left without words goes."""
    return line_dedup.deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest doc_id."""
    return ngram_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and whether the ids spell the text."""
    return subwords.round_trip(docs, MODEL)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates),
          ("decontamination", decontaminate), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
