"""Search over symbols and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DEFAULT_LIMIT = 20
RESULT = ("result_type", "kind", "name", "qualified_name", "signature", "file_path", "line_start", "line_end")


def active(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Active symbols of active files, with their paths. files: id, relative_path, absolute_path, is_active."""
    kept = files.where("is_active").select(F.col("id").alias("file_id"), "relative_path", "absolute_path")
    return symbols.where("is_active").join(kept, "file_id")


def search(symbols: DataFrame, files: DataFrame, query: str, kind: str = "", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first `limit` hits: symbols by kind, name and path, then files by path. `rank` is their order.

    symbols: active ones with relative_path and symbol_id; files: active ones. kind "file" asks for files only,
    any other kind for symbols only. A limit below one is the default.
    """
    limit = limit if limit > 0 else DEFAULT_LIMIT
    symbol_hits = symbols.where(T.contains_like(F.col("name"), query) | T.contains_like(F.col("qualified_name"), query) | T.contains_like(F.col("signature"), query))
    if kind:
        symbol_hits = symbol_hits.where(F.col("kind") == kind)
    of_symbols = symbol_hits.select(
        F.lit(0).alias("part"), F.lit("symbol").alias("result_type"), "kind", "name", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"),
        F.coalesce("signature", F.lit("")).alias("signature"), F.col("relative_path").alias("file_path"), F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), F.col("symbol_id").cast("string").alias("tie"),
    )
    of_files = files.where(T.contains_like(F.col("relative_path"), query) | T.contains_like(F.col("absolute_path"), query)).select(
        F.lit(1).alias("part"), F.lit("file").alias("result_type"), F.lit("file").alias("kind"), F.col("relative_path").alias("name"), F.lit("").alias("qualified_name"),
        F.lit("").alias("signature"), F.col("relative_path").alias("file_path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("").alias("tie"),
    )
    every = of_files if kind == "file" else of_symbols if kind else of_symbols.unionByName(of_files)
    order = ["part", F.when(F.col("part") == 0, F.col("kind")).otherwise(""), F.when(F.col("part") == 0, F.col("name")).otherwise(""), "file_path", "line_start", "tie"]
    return every.orderBy(*order).limit(limit).select(*RESULT)
