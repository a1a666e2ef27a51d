"""Building and maintaining an index: init, update, update of chosen files, staged builds, status, diagnostics.

Ids are hashes of what they name (repository, path, place in the file), so no global counter and no shuffle
is needed to number new rows, and a re-parsed file's unchanged symbols keep their ids.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_bytes
from ..operators import diff as D
from ..operators import parse as P
from ..operators import relations as R
from ..schemas import SCHEMA_VERSION, SYMBOLS, TABLES
from ..sources import tree
from .store import Store

METADATA = ("symbol_parameters", "symbol_relations", "changes", "snapshots")


def id_of(*parts: Column | str) -> Column:
    return F.abs(F.xxhash64(*parts).bitwiseAND(F.lit((1 << 62) - 1)))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def check_outside(repo_root: str, index_dir: str) -> None:
    if tree.inside(repo_root, index_dir):
        raise ValueError("the index directory must lie outside the repository")


def init(spark: SparkSession, repo_root: str, index_dir: str) -> int:
    """Add a repository; it becomes the one that is read. Returns its id."""
    repo_root = os.path.realpath(repo_root)
    if not os.path.isdir(repo_root):
        raise FileNotFoundError(repo_root)
    index_dir = os.path.realpath(index_dir)
    check_outside(repo_root, index_dir)
    os.makedirs(index_dir, exist_ok=True)
    store = Store(spark, index_dir)
    known = store.read("repositories")
    number = (known.agg(F.max("id")).first()[0] or 0) + 1
    now = F.current_timestamp()
    new = spark.range(1).select(
        F.lit(number).cast("long").alias("id"), F.lit(repo_root).alias("repo_root"), F.lit(index_dir).alias("index_root"), F.lit("").alias("repo_fingerprint"),
        F.lit(SCHEMA_VERSION).alias("schema_version"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("last_indexed_at"), F.lit(True).alias("read_only_repo"),
    )
    missing = {n: empty(spark, n) for n in TABLES if n not in store.pointer()["tables"] and n != "repositories"}
    store.publish({"repositories": known.unionByName(new)} | missing)
    return number


def repository(store: Store) -> dict:
    """The latest repository."""
    row = store.read("repositories").orderBy(F.desc("id")).limit(1).first()
    if row is None:
        raise RuntimeError("Repository metadata was not found. Run init first.")
    return row.asDict()


def scanned_rows(files: DataFrame, repository_id: int, snapshot: int) -> DataFrame:
    return files.withColumns({"repository_id": F.lit(repository_id).cast("long"), "id": id_of(F.lit(repository_id), "relative_path"), "snapshot": F.lit(snapshot).cast("long")})


def update(
    spark: SparkSession, index_dir: str, lite: bool = False, include: list[str] = (), exclude: list[str] = (), files: list[str] | None = None, closed: bool = True, force: bool = False, reporter=None
) -> dict:
    """Bring the index up to date with the tree, or with chosen files (an open set unless closed). Returns the summary.

    Only changed files are parsed: the join on path and hash comes before the parser. One version is published at the end;
    without a change only the time of the update is written. reporter: called with (phase, files done, files in all).
    """
    started = time.time()
    store = Store(spark, os.path.realpath(index_dir))
    if not store.exists():
        raise FileNotFoundError(f"there is no index in {index_dir}")
    size_before = store.size()
    repo = repository(store)
    check_outside(repo["repo_root"], repo["index_root"])
    if files is None:
        scan, counts = tree.scan(spark, repo["repo_root"], include, exclude)
        discovered, ignored = counts.first()
    else:
        scan, discovered, ignored = tree.scan_files(spark, repo["repo_root"], files), len(files), 0
    scan = scan.persist()
    report = reporter or (lambda phase, done, total: None)
    report("scanned", discovered, discovered)
    stored_all, symbols_all = store.read("files"), store.read("symbols")
    mine = F.col("repository_id") == repo["id"]
    stored = stored_all.where(mine)
    symbols_before = symbols_all.where(mine & F.col("is_active")).count()

    classified = D.classify(scan, stored, closed).persist()
    summary = D.summary(classified).first().asDict()
    changed = summary["added"] + summary["modified"] + summary["deleted"]
    waiting = summary["added"] + summary["modified"] + (summary["unchanged"] if force else 0)
    report("parsed", 0, waiting)
    snapshots = store.read("snapshots")
    snapshot = 0 if lite or not changed else (snapshots.agg(F.max("id")).first()[0] or 0) + 1
    now = F.current_timestamp()

    # files: rewritten where the status says so
    here = scanned_rows(scan, repo["id"], snapshot).join(classified.select("relative_path", "status", F.col("file_id").alias("known_id")), "relative_path")
    here = here.withColumn("id", F.coalesce("known_id", "id"))
    to_parse = here if force else here.where(F.col("status").isin(D.ADDED, D.MODIFIED))
    parsed = P.parse_files(to_parse, ["id"]).persist()
    read = parsed.select(F.col("id"), F.col("language").alias("new_language"), "failed")
    touched = here.where(F.col("status").isin(D.ADDED, D.MODIFIED)).select(
        "id", "repository_id", "relative_path", "absolute_path", "extension", "size_bytes", "line_count", "char_count", "last_modified_time", "content_hash", F.col("snapshot")
    )
    old = stored.select("id", F.col("first_seen_snapshot_id").alias("first"), F.col("last_seen_snapshot_id").alias("last"), F.col("parse_status").alias("was"))
    rewritten = touched.join(old, "id", "left").select(
        "id", "repository_id", "relative_path", "absolute_path", "extension", F.lit("").alias("language"), "size_bytes", "line_count", "char_count", "last_modified_time", "content_hash",
        F.lit(None).cast("string").alias("structure_hash"), F.coalesce("was", F.lit("not_parsed")).alias("parse_status"), F.lit(True).alias("is_active"),
        F.coalesce("first", "snapshot").alias("first_seen_snapshot_id"), F.col("snapshot").alias("last_seen_snapshot_id"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    gone = classified.where(F.col("status") == D.DELETED).select(F.col("file_id").alias("id"))
    kept = stored.join(rewritten.select("id"), "id", "left_anti")
    marked = kept.join(gone.withColumn("gone", F.lit(True)), "id", "left").withColumns(
        {
            "is_active": F.col("is_active") & F.col("gone").isNull(),
            "deleted_at": F.when(F.col("gone"), now).otherwise(F.col("deleted_at")),
            "last_seen_snapshot_id": F.when(F.col("gone"), F.lit(snapshot).cast("long")).otherwise(F.col("last_seen_snapshot_id")),
        }
    ).drop("gone")
    files_now = marked.unionByName(rewritten).join(read, "id", "left")
    good = F.col("failed") == F.lit(False)
    files_now = files_now.withColumns({"language": F.when(good, F.col("new_language")).otherwise(F.col("language")), "parse_status": F.when(good, "parsed").otherwise(F.col("parse_status"))}).drop("new_language", "failed")

    # symbols: those of parsed files are replaced, those of deleted files go inactive
    done = parsed.where(~F.col("failed"))
    exploded = P.explode_symbols(parsed, ["id"]).withColumnRenamed("id", "file_id").persist()
    number = lambda ordinal: id_of("file_id", ordinal, F.lit("symbol"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in spark.createDataFrame([], SYMBOLS).schema.fields}
    new_symbols = exploded.select(
        *[
            {
                "id": number("ordinal"), "repository_id": F.lit(repo["id"]).cast("long"), "parent_symbol_id": F.when(F.col("parent_index") >= 0, number("parent_index")),
                "description": F.lit(""), "tags": F.lit(""), "ai_description": F.lit(""), "ai_tags": F.lit(""), "ai_model": F.lit(""), "is_active": F.lit(True),
            }.get(n, F.col(n) if n in exploded.columns else c).alias(n)
            for n, c in blank.items()
        ]
    )
    old_of_parsed = symbols_all.join(done.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    counts = D.symbol_counts(old_of_parsed, new_symbols).first()
    survivors = symbols_all.join(done.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    off = survivors.join(gone.select(F.col("id").alias("file_id"), F.lit(True).alias("gone")), "file_id", "left")
    deactivated = off.where("gone and is_active").count()
    off = off.withColumns({"is_active": F.col("is_active") & F.col("gone").isNull(), "deleted_at": F.when(F.col("gone") & F.col("is_active"), now).otherwise(F.col("deleted_at"))}).drop("gone")
    symbols_now = off.unionByName(new_symbols)

    tables = {"files": stored_all.where(~mine).unionByName(files_now.select(*stored_all.columns)), "symbols": symbols_now.select(*symbols_all.columns)}
    parsed_ids = done.select(F.col("id").alias("file_id"))
    dead_symbols = old_of_parsed.select(F.col("id").alias("dead"))
    if lite:
        tables |= {n: empty(spark, n) for n in METADATA}
    else:
        p = P.explode_parameters(exploded, ["file_id"]).select(
            id_of("file_id", "ordinal", "position", F.lit("parameter")).alias("id"), number("ordinal").alias("symbol_id"), "name", "type", "default_value", "position", "direction"
        )
        params = store.read("symbol_parameters").join(dead_symbols.withColumnRenamed("dead", "symbol_id"), "symbol_id", "left_anti")
        tables["symbol_parameters"] = params.unionByName(p.select(*params.columns))
        links = R.containment(exploded).select("file_id", "source", "target", "relation_type", "source_text", "target_text")
        kinds = R.type_relations(exploded).withColumn("target", F.lit(None).cast("int")).select(*links.columns)
        r = links.unionByName(kinds).select(
            id_of("file_id", "source", "relation_type", "target_text", F.coalesce("target", F.lit(-1))).alias("id"), F.lit(repo["id"]).cast("long").alias("repository_id"),
            number("source").alias("source_symbol_id"), F.when(F.col("target").isNotNull(), number("target")).alias("target_symbol_id"), "relation_type", "source_text", "target_text", F.lit(1.0).alias("confidence"),
        )
        rel = store.read("symbol_relations").join(dead_symbols.withColumnRenamed("dead", "source_symbol_id"), "source_symbol_id", "left_anti")
        tables["symbol_relations"] = rel.select(*r.columns).unionByName(r)
        if snapshot:
            made = spark.range(1).select(F.lit(snapshot).cast("long").alias("id"), F.lit(repo["id"]).cast("long").alias("repository_id"), now.alias("created_at"), F.lit(None).cast("string").alias("git_commit"), F.lit("update").alias("description"))
            tables["snapshots"] = snapshots.unionByName(made)
            log = D.changes(classified).withColumn("path", F.coalesce(F.nullif("new_path", F.lit("")), "old_path"))
            log = log.select(
                id_of(F.lit(snapshot), "path").alias("id"), F.lit(repo["id"]).cast("long").alias("repository_id"), F.lit(snapshot).cast("long").alias("snapshot_id"), "entity_type",
                id_of(F.lit(repo["id"]), "path").alias("entity_id"), "change_type", "old_hash", "new_hash", "old_path", "new_path", now.alias("created_at"),
            )
            tables["changes"] = store.read("changes").unionByName(log)
    if not changed and not force and not lite:
        tables = {}  # nothing to rewrite
    repos = store.read("repositories")
    tables["repositories"] = repos.withColumn("last_indexed_at", F.when(F.col("id") == repo["id"], now).otherwise(F.col("last_indexed_at")))
    store.publish(tables)

    bad = [r.id for r in parsed.where("failed").select("id").collect()]  # files whose parser raised
    source_bytes = scan.agg(F.sum("size_bytes")).first()[0] or 0
    parsed_files, seen = done.count(), to_parse.count()
    report("parsed", seen, waiting)
    symbols_after = store.read("symbols").where(mine & F.col("is_active")).count()
    for df in (scan, classified, parsed, exploded):
        df.unpersist()
    return summary | {
        "repo_root": repo["repo_root"], "index_root": repo["index_root"], "lite_mode": lite, "snapshot_id": snapshot, "discovered": discovered, "ignored": ignored,
        "processed": summary["added"] + summary["modified"] + summary["unchanged"], "failed": len(bad), "parsed": parsed_files, "skipped": seen - parsed_files - len(bad),
        "source_bytes": source_bytes, "symbols_before": symbols_before, "symbols_added": counts.added, "symbols_updated": counts.updated, "symbols_deleted": counts.deleted,
        "symbols_deactivated": deactivated, "symbols_after": symbols_after, "size_before": size_before, "size_after": store.size(),
        "warnings": [f"{len(bad)} files could not be parsed."] if bad else [], "elapsed_seconds": round(time.time() - started, 3),
    }


def update_files(spark: SparkSession, index_dir: str, repo_root: str, files: list[str], lite: bool = False, replace: bool = False, reporter=None) -> dict:
    """Update chosen files; other files stay as they are, or are deleted with replace. Makes the index if needed."""
    store = Store(spark, os.path.realpath(index_dir)) if os.path.isdir(index_dir) else None
    if store is None or not store.exists() or repository(store)["repo_root"] != os.path.realpath(repo_root):
        init(spark, repo_root, index_dir)
    return update(spark, index_dir, lite, files=files, closed=replace, reporter=reporter)


def update_staged(spark: SparkSession, index_dir: str, include: list[str] = (), exclude: list[str] = (), reporter=None) -> tuple[dict, dict]:
    """A quick lite version first, then a full one; each is published whole."""
    return update(spark, index_dir, True, include, exclude, reporter=reporter), update(spark, index_dir, False, include, exclude, force=True, reporter=reporter)


def update_root(spark: SparkSession, index_dir: str, include_file: str | None = None, exclude_file: str | None = None, root: str | None = None, lite: bool = False, staged: bool = False, reporter=None):
    """Index what a list of paths names; the repository is their common root unless given."""
    include = tree.read_path_list(include_file) if include_file else []
    exclude = tree.read_path_list(exclude_file) if exclude_file else []
    root = os.path.realpath(root or tree.common_root(include))
    os.makedirs(index_dir, exist_ok=True)
    store = Store(spark, os.path.realpath(index_dir))
    if not store.exists() or repository(store)["repo_root"] != root:
        init(spark, root, index_dir)
    return update_staged(spark, index_dir, include, exclude, reporter)[1] if staged else update(spark, index_dir, lite, include, exclude, reporter=reporter)


def status(spark: SparkSession, index_dir: str) -> dict:
    repo = repository(Store(spark, os.path.realpath(index_dir)))
    return {k: str(v) if k.endswith("_at") and v is not None else v for k, v in repo.items()}


def diagnostics(spark: SparkSession, index_dir: str) -> dict:
    store = Store(spark, os.path.realpath(index_dir))
    counts = {n: store.read(n).count() for n in TABLES}
    return counts | {"size_bytes": store.size(), "size": format_bytes(store.size())}


def compact(spark: SparkSession, index_dir: str) -> dict:
    before, after = Store(spark, os.path.realpath(index_dir)).compact()
    return {"size_before": before, "size_after": after}
