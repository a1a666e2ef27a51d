"""Command line: python -m symquarry COMMAND."""

from __future__ import annotations

import argparse
import json
import sys

VERSION = "0.1.0"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.appName("symquarry")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def bar(phase: str, done: int, total: int, width: int = 24) -> str:
    """A line of progress, as wide for any counts."""
    filled = width if not total else width * done // total
    return f"[{'#' * filled}{'-' * (width - filled)}] {done} / {total} {phase}"


def reporter_of(a: argparse.Namespace):
    """What shows an update's progress on the error stream: a line for each phase with --verbose, one bar otherwise, or nothing."""
    if a.quiet or a.no_progress:
        return None
    end = "\n" if a.verbose or not sys.stderr.isatty() else "\r"
    return lambda phase, done, total: print(bar(phase, done, total), end=end, file=sys.stderr, flush=True)


def csv(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symquarry", description="Index source trees and answer search and context queries.")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command")

    def command(name: str, *flags: str, **options: dict):
        c = sub.add_parser(name)
        for f in flags:
            c.add_argument(f, action="store_true")
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **v)
        return c

    needed, text = {"required": True}, {"choices": ("text", "json"), "default": "text"}
    shown = ("--quiet", "--verbose", "--no-progress")
    command("init", index_dir=needed).add_argument("repo")
    for name in ("status", "diagnostics", "compact"):
        command(name, index_dir=needed)
    command("update", "--lite", "--staged", *shown, index_dir=needed, format=text)
    command("updateroot", "--lite", "--staged", *shown, index_dir=needed, include_file={}, exclude_file={}, repo_root={}, format=text)
    command("update-files", "--lite", "--replace", *shown, index_dir=needed, repo_root=needed, files=needed, format=text)
    command("search", "--partial", index_dir=needed, query=needed, kind={"default": ""}, limit={"type": int, "default": 20}, format=text)
    command(
        "context", "--partial", "--basic", "--include-tree", "--include-types", "--grow", "--lite", index_dir=needed, symbols=needed,
        level={"type": int, "default": 0}, budget_chars={"type": int, "default": 60000}, grow_files={"default": ""}, format={"default": "json"},
    )
    command("direct-context", file=needed, signature=needed, repo_root={}, budget_chars={"type": int, "default": 60000})
    command("serve", index_dir=needed, port={"type": int, "default": 7123})
    command("enrich", "--changed-only", index_dir=needed)
    return p


def show_update(s: dict) -> str:
    from .functions.text import format_bytes

    lines = [f"{k}: {s[k]}" for k in ("added", "modified", "deleted", "unchanged", "failed", "processed", "discovered", "ignored")]
    lines += [f"symbols: {s['symbols_before']} -> {s['symbols_after']} (+{s['symbols_added']}, updated {s['symbols_updated']}, deleted {s['symbols_deleted']}, off {s['symbols_deactivated']})"]
    lines += [f"source: {format_bytes(s['source_bytes'])}, index: {format_bytes(s['size_after'])} (growth {format_bytes(s['size_after'] - s['size_before'])}), {s['elapsed_seconds']} s"]
    return "\n".join(lines + [f"warning: {w}" for w in s["warnings"]])


def show_search(found: dict) -> str:
    rows = found["results"]
    return "\n".join(f"{r['kind']} {r['qualified_name'] or r['name']}  {r['file']}:{r['line_start']}-{r['line_end']}" for r in rows) or "No results."


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, default=str)


def main(argv: list[str] | None = None) -> int:
    from .plans import answers, index
    from .ship import ship

    a = parser().parse_args(argv)
    if not a.command:
        parser().print_help()
        return 0
    spark = session()
    ship(spark)
    try:
        if a.command == "init":
            print(f"repository {index.init(spark, a.repo, a.index_dir)} is ready")
        elif a.command == "status":
            print(dump(index.status(spark, a.index_dir)))
        elif a.command == "diagnostics":
            print(dump(index.diagnostics(spark, a.index_dir)))
        elif a.command == "compact":
            print(dump(index.compact(spark, a.index_dir)))
        elif a.command in ("update", "updateroot", "update-files"):
            show = reporter_of(a)
            if a.command == "update":
                s = index.update_staged(spark, a.index_dir, reporter=show)[1] if a.staged else index.update(spark, a.index_dir, a.lite, reporter=show)
            elif a.command == "updateroot":
                s = index.update_root(spark, a.index_dir, a.include_file, a.exclude_file, a.repo_root, a.lite, a.staged, show)
            else:
                s = index.update_files(spark, a.index_dir, a.repo_root, csv(a.files), a.lite, a.replace, show)
            if not a.quiet:
                print(dump(s) if a.format == "json" else show_update(s))
        elif a.command == "search":
            found = answers.search(spark, a.index_dir, a.query, a.kind, a.limit)
            print(dump(found) if a.format == "json" else show_search(found))
        elif a.command == "context":
            if a.grow:
                answers.grow(spark, a.index_dir, csv(a.symbols), csv(a.grow_files), a.partial, a.lite)
            print(dump(answers.context(spark, a.index_dir, csv(a.symbols), a.partial, a.basic, a.level, a.budget_chars, a.include_tree, a.include_types)))
        elif a.command == "direct-context":
            print(dump(answers.direct_context(spark, a.file, a.signature, a.repo_root, a.budget_chars)))
        elif a.command == "serve":
            from .serve import serve

            serve(spark, a.index_dir, a.port)
        elif a.command == "enrich":
            print(dump(answers.enrich(spark, a.index_dir, a.changed_only)))
    except (OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
