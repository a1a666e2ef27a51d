"""The driver tables seen as a source tree: documents as shell scripts, pages as markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("documents/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".sh"))
    return d.select(path.alias("relative_path"), F.col("text").alias("content"), "doc_id", "lang", "source")


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put nearly everything on one line; a line break between tags gives the line grammar lines."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return p.select(path.alias("relative_path"), F.replace("html", F.lit("><"), F.lit(">\n<")).alias("content"), "page_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(spark, sf_dir).select("relative_path", "content").unionByName(pages_as_files(spark, sf_dir).select("relative_path", "content"))
