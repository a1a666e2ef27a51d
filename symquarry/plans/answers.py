"""Queries over an index as JSON-ready values: search, context, direct context, enrichment."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import parse as P
from ..operators import search as S
from ..sources import tree
from . import enrich as E
from . import index as I
from .store import Store


def _open(spark: SparkSession, index_dir: str) -> tuple[Store, dict, DataFrame, DataFrame]:
    store = Store(spark, os.path.realpath(index_dir))
    repo = I.repository(store)
    mine = F.col("repository_id") == repo["id"]
    files = store.read("files").where(mine)
    symbols = S.active(store.read("symbols").where(mine), files).withColumn("symbol_id", F.col("id"))
    return store, repo, files.where("is_active"), symbols


def search(spark: SparkSession, index_dir: str, query: str, kind: str = "", limit: int = S.DEFAULT_LIMIT) -> dict:
    _, _, files, symbols = _open(spark, index_dir)
    rows = S.search(symbols, files, query, kind, limit).collect()  # at most `limit`
    return {"results": [{"type": r.result_type, "kind": r.kind, "name": r.name, "qualified_name": r.qualified_name, "signature": r.signature, "file": r.file_path, "line_start": r.line_start, "line_end": r.line_end} for r in rows]}


def live_content(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(relative_path, content) of the files as they are now, which may be newer than the index."""
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for rel, path in zip(b.relative_path, b.absolute_path):
                if os.path.exists(path):
                    with open(path, "rb") as f:
                        rows.append((rel, f.read()))
            yield pd.DataFrame(rows, columns=["relative_path", "content"])

    return files.select("relative_path", "absolute_path").mapInPandas(run, StructType([StructField("relative_path", StringType()), StructField("content", BinaryType())]))


def _item(r, basic: bool) -> dict:
    code = bytes(r.code).decode("utf-8", "replace")
    if basic:
        return {"level": r.level, "file": r.relative_path, "line_start": r.line_start, "line_end": r.line_end, "code": code}
    return {
        "requested_symbol": r.requested_symbol, "level": r.level, "kind": r.kind, "name": r.name, "qualified_name": r.qualified_name, "signature": r.signature, "file": r.relative_path,
        "line_start": r.line_start, "line_end": r.line_end, "related": r.related, "relation_type": r.relation_type, "source_qualified_name": r.source_qualified_name,
        "truncated": r.truncated, "code": code,
    }


def context(
    spark: SparkSession, index_dir: str, requested: list[str], partial: bool = False, basic: bool = False, level: int = 0, budget: int = 60000, tree_paths: bool = False, types: bool = False
) -> dict:
    store, repo, files, symbols = _open(spark, index_dir)
    budget = (1 << 31) - 1 if basic else max(0, budget)
    relations = store.read("symbol_relations").where(F.col("repository_id") == repo["id"]) if types and not basic else None
    found = C.find(symbols, requested, partial)
    counts = C.ambiguity(found, requested).collect()  # one row per request
    needed = symbols.select("relative_path", "absolute_path").distinct() if level or relations is not None else found.select("relative_path", "absolute_path").distinct()
    content = live_content(spark, needed)
    items = C.context(symbols, content, requested, partial, budget, level, relations).persist()
    rows = items.orderBy("seq").collect()  # bounded by the byte budget's items
    by_name = {r.requested_symbol: r.matches for r in counts}
    said = []
    for name in requested:
        if not by_name[name]:
            said.append(f"Symbol not found{' by partial match' if partial else ''}: {name}")
        elif by_name[name] > 1:
            said.append(f"Ambiguous {'partial ' if partial else ''}symbol: {name} matched {by_name[name]} candidates")
    said += [r.warning for r in C.warnings(items).orderBy("seq").collect()]
    if basic:
        return {"symbols": [_item(r, True) for r in rows], "warnings": said}
    used = sum(r.taken for r in rows)
    paths = [r.relative_path for r in files.select("relative_path").orderBy("relative_path").collect()] if tree_paths else []
    return {
        "repository": {"repo_root": repo["repo_root"], "index_root": repo["index_root"], "last_indexed_at": str(repo["last_indexed_at"] or "")},
        "query": {"symbols": requested, "partial": partial},
        "budget": {"requested_chars": budget, "used_chars": used, "remaining_chars": budget - used},
        "symbols": [_item(r, False) for r in rows], "reduced_file_tree": paths, "warnings": said,
    }


def grow(spark: SparkSession, index_dir: str, requested: list[str], files: list[str], partial: bool = False, lite: bool = False) -> bool:
    """Index the given files if some request has no match; whether it did."""
    if not files:
        raise ValueError("growing needs the files to grow by")
    _, repo, _, symbols = _open(spark, index_dir)
    missing = C.ambiguity(C.find(symbols, requested, partial), requested).where("matches = 0").limit(1).count()
    if missing:
        I.update_files(spark, index_dir, repo["repo_root"], files, lite)
    return bool(missing)


def direct_context(spark: SparkSession, file: str, signature: str, repo_root: str | None = None, budget: int = 60000) -> dict:
    """Context of one file without an index."""
    path = os.path.realpath(file)
    root = os.path.realpath(repo_root or os.path.dirname(path))
    if not tree.inside(root, path):
        raise ValueError("the file must lie inside the repository root")
    one = tree.scan_files(spark, root, [path])
    symbols = P.explode_symbols(P.parse_files(one, ["relative_path"]), ["relative_path"])
    hits = symbols.where(C.matches_signature(signature)).withColumns(
        {"seq": F.col("ordinal").cast("long"), "requested_symbol": F.lit(signature), "symbol_id": F.col("ordinal").cast("long"), "level": F.lit(0), "related": F.lit(False), "relation_type": F.lit(""), "source_qualified_name": F.lit("")}
    )
    items = C.spend(C.with_code(hits.select(*C.ITEM), one), max(0, budget)).persist()
    rows = items.orderBy("seq").collect()  # symbols of one file
    said = [r.warning for r in C.warnings(items).orderBy("seq").collect()] or ([] if rows else [f"Signature not found in file: {signature}"])
    used = sum(r.taken for r in rows)
    return {
        "repository": {"repo_root": root, "index_root": "", "last_indexed_at": "realtime"}, "query": {"symbols": [signature], "partial": True},
        "budget": {"requested_chars": max(0, budget), "used_chars": used, "remaining_chars": max(0, budget) - used},
        "symbols": [_item(r, False) for r in rows], "reduced_file_tree": [], "warnings": said,
    }


def enrich(spark: SparkSession, index_dir: str, changed_only: bool = False, provider: E.Provider | None = None) -> dict:
    provider = provider or E.provider_of(E.load_config(index_dir))
    if not provider.enabled():
        return {"processed": 0, "enriched": 0, "failed": 0, "skipped": 0}
    store, repo, _, symbols = _open(spark, index_dir)
    chosen = E.pending(symbols) if changed_only else symbols
    results = E.run_provider(chosen, provider).persist()
    done = results.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("description") != "").cast("int")), F.lit(0)).alias("good")).first()
    store.publish({"symbols": E.apply(store.read("symbols"), results)})
    results.unpersist()
    return {"processed": done.n, "enriched": done.good, "failed": done.n - done.good, "skipped": 0}
