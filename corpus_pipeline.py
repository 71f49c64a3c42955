"""A training corpus from raw documents: filter, clean, deduplicate, pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all
but the last return the columns of ``documents``. ``run`` writes each stage's result to the
shared folder and reads it again.

Nulls: a null text is an empty one and becomes it in the second stage, where ``n_chars`` is
counted anew. Rows without an id, and those that share one, are copies or stay like any
others. Repeated rows of one id and text count as copies of each other. Empty tables pass
through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarind.llm import lines, mil, packing, simhash
from tamarind.llm.common import free_name
from tamarind.session import release, stage, staged


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier, trained on the labels of these, accepts; all without a usable label."""
    model = mil.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    score = free_name(docs, "_quality_score")
    return mil.score(docs, model, out=score).filter(F.col(score) >= mil.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents hold."""
    cleaned = lines.drop_frequent_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows with like sets of five-word shingles, one of the least id; null ids come last."""
    return simhash.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_attention", keep_good_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the classifier nor the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        mark = staged()
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark, kept=1)  # what the step itself has staged
    return STAGES[-1][1](spark, docs, sf_dir)
