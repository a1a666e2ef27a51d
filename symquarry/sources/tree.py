"""A source tree as a DataFrame: one row for each file, with content, statistics and hash."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Directories that are never entered (fixed values).
IGNORED = (".git", "bin", "obj", "node_modules", "build", "dist", ".vs", ".idea")


def comparable(path: str) -> str:
    return os.path.normpath(path.replace("\\", "/")).lower()


def inside(parent: str, child: str) -> bool:
    """Whether child is parent or below it; case does not count."""
    a, b = comparable(parent), comparable(child)
    return a == b or b.startswith(a.rstrip("/") + "/")


def read_path_list(file: str) -> list[str]:
    """One path per line; quotes may surround it; blank lines and # lines say nothing."""
    out = []
    with open(file, encoding="utf-8") as f:
        for line in f:
            text = line.strip(" \t\n\v\f\r")
            if len(text) > 1 and text[0] == text[-1] == '"':
                text = text[1:-1]
            if text and not text.startswith("#"):
                out.append(text)
    return out


def common_root(paths: list[str]) -> str:
    """Deepest directory above all paths, which must exist."""
    if not paths:
        raise ValueError("no paths are given")
    for p in paths:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
    real = [os.path.realpath(p) for p in paths]
    return os.path.commonpath([p if os.path.isdir(p) else os.path.dirname(p) for p in real])


def plan_includes(root: str, include: list[str], exclude: list[str]) -> tuple[list[str], list[str], int]:
    """(include roots, exclude roots, ignored so far): missing ones dropped, covered and excluded includes dropped."""
    real = lambda p: os.path.realpath(p if os.path.isabs(p) else os.path.join(root, p))
    excluded = [real(p) for p in exclude if os.path.exists(real(p))]
    kept: list[str] = []
    ignored = 0
    for p in [real(x) for x in include] if include else [os.path.realpath(root)]:
        if not os.path.exists(p):
            continue
        if any(inside(e, p) for e in excluded):
            ignored += 1
        elif not any(inside(k, p) for k in kept):
            kept.append(p)
    return kept, excluded, ignored


def pruned_prefix(path: Column, names: tuple[str, ...] = IGNORED) -> Column:
    """The shallowest ignored directory on a relative path, '' if there is none."""
    sign = "|".join(n.replace(".", r"\.") for n in names)
    return F.regexp_extract(path, rf"^((?:[^/]+/)*?(?:{sign}))/", 1)


def is_under(path: Column, parents: list[str]) -> Column:
    """Containment in any of some absolute directories; ASCII case does not count."""
    low = T.ascii_lower(path)
    hit = F.lit(False)
    for p in parents:
        q = comparable(p)
        hit = hit | (low == q) | low.startswith(q.rstrip("/") + "/")
    return hit


def with_statistics(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds size_bytes, char_count, line_count and content_hash of a text or binary column."""
    raw = F.col(content).cast("binary")
    size = F.octet_length(raw).cast("long")
    as_text = F.decode(raw, "ISO-8859-1")
    return files.withColumns(
        {"size_bytes": size, "char_count": size, "line_count": T.line_count(as_text).cast("long"), "content_hash": T.fnv1a64(F.col(content))}
    )


def literal(path: str) -> str:
    """path, with the signs that the reader takes for patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def scan(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, counts). files: relative_path, absolute_path, extension, last_modified_time, content and statistics.
    counts: one row (discovered, ignored); ignored directories count once each, files inside them not at all.
    """
    root = os.path.realpath(root)
    roots, excluded, already = plan_includes(root, list(include), list(exclude))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not roots:
        raw = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    else:
        raw = reader.load([f"file://{literal(r)}" for r in roots])
    absolute = F.regexp_replace("path", "^file:/+", "/")
    listed = raw.withColumn("absolute_path", absolute)
    above = F.lit(root.rstrip("/") + "/")
    listed = listed.withColumn("relative_path", F.when(F.col("absolute_path").startswith(above), F.substr("absolute_path", F.length(above) + 1)).otherwise(F.col("absolute_path")))
    # an include root itself is entered even if its name is ignored
    base = F.coalesce(*[F.when(F.col("absolute_path").startswith(r.rstrip("/") + "/"), F.lit(len(r.rstrip("/")) + 1)) for r in roots], F.lit(0)) if roots else F.lit(0)
    below = F.substr("absolute_path", base + 1)
    marked = listed.withColumn("pruned", pruned_prefix(below)).withColumn("excluded", is_under(F.col("absolute_path"), excluded))
    kept = marked.where("pruned = '' and not excluded").dropDuplicates(["relative_path"])
    ignored = marked.where("pruned <> '' and not excluded").select(F.concat(F.substr("absolute_path", F.lit(1), base), F.col("pruned")).alias("d")).distinct()
    counts = (
        kept.agg(F.count(F.lit(1)).alias("files"))
        .crossJoin(ignored.agg(F.count(F.lit(1)).alias("dirs")))  # two single rows
        .select((F.col("files") + F.col("dirs") + already).alias("discovered"), (F.col("dirs") + already).alias("ignored"))
    )
    named = kept.withColumn("extension", F.regexp_extract(T.file_name(F.col("relative_path")), r"^.+(\.[^.]*)$", 1)).withColumnRenamed("modificationTime", "last_modified_time")
    columns = ("relative_path", "absolute_path", "extension", "size_bytes", "line_count", "char_count", "last_modified_time", "content_hash", "content")
    return with_statistics(named).select(*columns), counts


def scan_files(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """The same rows for chosen files, which must exist, be regular and lie inside root."""
    root = os.path.realpath(root)
    real = [os.path.realpath(f if os.path.isabs(f) else os.path.join(root, f)) for f in files]
    for f in real:
        if not os.path.isfile(f):
            raise FileNotFoundError(f)
        if not inside(root, f):
            raise ValueError(f"{f} is outside {root}")
    return scan(spark, root, include=real)[0]
