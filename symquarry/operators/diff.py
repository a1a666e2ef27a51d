"""Incremental maintenance: what changed between a scan and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDED, MODIFIED, DELETED, UNCHANGED = "file_added", "file_modified", "file_deleted", "unchanged"


def classify(scanned: DataFrame, stored: DataFrame, closed: bool = True) -> DataFrame:
    """Every path with its status, old and new hash, file id and whether it has to be parsed.

    scanned: relative_path, content_hash and more; stored: relative_path, id, content_hash, is_active. An open
    set (closed=False) leaves files that were not scanned alone. Inactive files that come back count as added.
    """
    new = scanned.select("relative_path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("__here"))
    old = stored.select("relative_path", F.col("id").alias("file_id"), F.col("content_hash").alias("old_hash"), "is_active")
    both = new.join(old, "relative_path", "full_outer" if closed else "left")
    here, known = F.col("__here").isNotNull(), F.coalesce("is_active", F.lit(False))
    status = (
        F.when(here & ~known, ADDED)
        .when(here & (F.col("old_hash") != F.col("new_hash")), MODIFIED)
        .when(here, UNCHANGED)
        .when(known, DELETED)
        .otherwise(F.lit("gone"))  # inactive already
    )
    return both.withColumn("status", status).select("relative_path", "status", "file_id", F.coalesce("old_hash", F.lit("")).alias("old_hash"), F.coalesce("new_hash", F.lit("")).alias("new_hash"))


def changes(diff: DataFrame) -> DataFrame:
    """Change log rows: added files have no old side, deleted ones no new side."""
    changed = diff.where(F.col("status").isin(ADDED, MODIFIED, DELETED))
    old, new = F.col("status") != ADDED, F.col("status") != DELETED
    return changed.select(
        F.lit("file").alias("entity_type"), F.col("status").alias("change_type"),
        F.when(old, F.col("old_hash")).otherwise("").alias("old_hash"), F.when(new, F.col("new_hash")).otherwise("").alias("new_hash"),
        F.when(old, F.col("relative_path")).otherwise("").alias("old_path"), F.when(new, F.col("relative_path")).otherwise("").alias("new_path"),
    )


def summary(diff: DataFrame) -> DataFrame:
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s.removeprefix("file_"))
    return diff.agg(*[count(s) for s in (ADDED, MODIFIED, DELETED, UNCHANGED)])


def symbol_counts(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """(added, updated, deleted) over re-parsed files: every insert is an addition, replaced ones are updates too."""
    a = old.groupBy(key).agg(F.count(F.lit(1)).alias("old"))
    b = new.groupBy(key).agg(F.count(F.lit(1)).alias("new"))
    both = a.join(b, key, "full_outer").select(F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(total("new").alias("added"), total(F.least("old", "new")).alias("updated"), total(F.greatest(F.lit(0), F.col("old") - F.col("new"))).alias("deleted"))
