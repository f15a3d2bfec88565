"""Training-corpus pipeline: documents to packed sequences, one operator a stage.

Every stage takes what its predecessor kept and is written as Parquet under
the shared folder and read again before the next. All stages but the last
return the columns of ``documents``; the last returns the packed pieces.

Defined results of every stage: NULL and empty texts are judged as texts without words (the quality rules reject them);
NULL ids, languages and sources are values of their own; repeated rows are judged alike, and the exact
stage keeps one of them; an empty table gives an empty table; extra columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dispute_engine.llm import exact, jaccard, packing, quality, toxicity
from dispute_engine.llm.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model learns from ``labels`` of the training folds."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's adaptive thresholds."""
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact.keep_first(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the row with the smallest doc_id."""
    return jaccard.keep_one(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in sequences of 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the learned stages nor the tokeniser; tests compare with brute force instead.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
