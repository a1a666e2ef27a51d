"""The corpus pipeline: toxicity, near duplicates, contamination, secrets, packing.

Every stage takes the documents that its predecessor kept, with all their columns, and returns the documents
it keeps; the last one returns pieces placed in training sequences. `run` writes each stage's result to the
shared folder and reads it again, so a lost executor costs no more than the stage at work.

Every stage takes null ids and null texts (a null text counts as empty and stays null), repeated rows (judged alike;
of near duplicates one row stays), ties (the smallest id stays) and empty tables (the result is empty), and leaves
columns that it does not know as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symquarry.llm import decontamination, near_copies, packing, secret_scan, toxicity
from symquarry.llm.common import new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, scorer, column="__toxicity").where(F.col("__toxicity") < 0.5).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word Jaccard similarity of 0.8 or more, the one with the smallest id.

    SimHash with multi-index hashing finds candidates, exact similarity decides, and a prefix search finds what the radius misses.
    """
    return near_copies.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the models nor the fingerprints of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
