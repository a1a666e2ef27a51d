"""Context queries: matching symbols, their snippets under a byte budget, related types, expansion by level.

Items carry `seq`, their place in the answer; a budget is spent in that order. All of it is joins and windows
over the items of one query; code comes from the files joined by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..sources.scratch import materialised
from .lines import raw_lines, snippet
from .relations import related_types

FEW = 200_000  # keys that are broadcast, at most
ITEM = ("seq", "requested_symbol", "symbol_id", "kind", "name", "qualified_name", "signature", "relative_path", "line_start", "line_end", "level", "related", "relation_type", "source_qualified_name")


def find(symbols: DataFrame, requested: list[str], partial: bool = False) -> DataFrame:
    """One row for each request and matching active symbol, in order (seq). A repeated request matches again."""
    hits = []
    q = F.coalesce("qualified_name", F.lit(""))
    for number, name in enumerate(requested):  # the user's list
        exact = (F.col("name") == name) | (q == name)
        hit = exact | T.contains_like(F.col("name"), name) | T.contains_like(q, name) | T.contains_like(F.col("signature"), name) if partial else exact
        first = F.when(exact, 0).otherwise(1) if partial else F.lit(0)
        hits.append(F.when(hit, F.struct(F.lit(number).alias("request"), F.lit(name).alias("requested_symbol"), first.alias("first"))))
    every = symbols.select("*", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("__hit")).select(*symbols.columns, "__hit.*")
    order = W.orderBy("request", "first", "kind", "qualified_name", "relative_path", "symbol_id")
    return every.withColumn("seq", F.row_number().over(order).cast("long"))


def ambiguity(found: DataFrame, requested: list[str]) -> DataFrame:
    """(requested_symbol, matches) of every request, none included."""
    asked = found.sparkSession.createDataFrame([(i, r) for i, r in enumerate(requested)], "request int, requested_symbol string")
    counts = found.groupBy("request").agg(F.count(F.lit(1)).alias("matches"))
    return asked.join(counts, "request", "left").select("requested_symbol", F.coalesce("matches", F.lit(0)).alias("matches"))


def with_code(items: DataFrame, files: DataFrame, keep=None) -> DataFrame:
    """Adds code, the lines of each item as bytes. files: relative_path, content. keep: materialises the items, so that only
    their files are shuffled."""
    if keep:
        items = keep(items)
        files = among(files, keep(items.select("relative_path").distinct()), "relative_path")
    kept = files.select("relative_path", F.col("content").cast("string").alias("__content"))
    lines = snippet(raw_lines(F.col("__content")), F.col("line_start"), F.col("line_end"))
    return items.join(kept, "relative_path", "left").withColumn("code", F.coalesce(lines, F.lit("")).cast("binary")).drop("__content")


def spend(items: DataFrame, budget: int | Column) -> DataFrame:
    """Adds taken and truncated; code is cut to its taken bytes. Later items get what earlier ones left."""
    size = F.octet_length("code").cast("long")
    earlier = F.coalesce(F.sum(size).over(W.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0).cast("long"), F.lit(budget) - earlier if isinstance(budget, int) else budget - earlier)
    spent = items.withColumn("remaining", left).withColumn("taken", F.least(size, F.col("remaining"))).withColumn("truncated", (F.col("remaining") == 0) | (size > F.col("remaining")))
    return spent.withColumn("code", F.substring("code", F.lit(1), F.col("taken").cast("int")))


def warnings(items: DataFrame) -> DataFrame:
    """(seq, warning) of every truncated item."""
    said = F.when(F.col("remaining") > 0, "Snippet truncated by budget: ").otherwise("Snippet omitted by budget: ")
    return items.where("truncated").select("seq", F.concat(said, "qualified_name").alias("warning"))


def expandable(kind: Column) -> Column:
    return kind.rlike("|".join(T.EXPANDABLE))


def among(df: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """df joined with keys, a materialised table, by a column. While keys are FEW they are broadcast, so that df is not shuffled."""
    return df.join(F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys, column, how)


def first_references(frontier: DataFrame, symbols: DataFrame, keep) -> DataFrame:
    """(symbol_id, source_seq) of every expandable symbol whose name, or last part of its qualified name, stands alone in an
    item's code, with the first such item. An item's own symbol may be among them.

    A word counts once, with the first item that holds it, so work grows with items plus names, not with their product.
    Names made of identifier characters are words of the code. Names with other signs can only stand where their longest run
    of identifier characters is a word; those that can are matched as patterns, each once, against the items with that word.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z0-9_$]+"), F.lit(0))
    # names without any such run stand under the empty word, which is in every item
    held = frontier.select("seq", F.explode(F.array_union(F.array(F.lit("")), runs(F.decode("code", "ISO-8859-1")))).alias("part"))
    words = keep(held.groupBy("part").agg(F.min("seq").alias("source_seq")))
    tail = T.tail_name(F.coalesce("qualified_name", F.lit("")))
    names = symbols.where(expandable(F.col("kind"))).select("symbol_id", F.explode(F.array_distinct(F.array("name", F.when(tail != "", tail).otherwise(F.col("name"))))).alias("word"))
    longest = F.aggregate(runs(F.col("word")), F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a))
    hits = keep(among(names.where(F.octet_length("word") >= 3).withColumn("part", longest), words, "part", "inner"))
    plain = F.col("word") == F.col("part")
    odd = hits.where(~plain).select("symbol_id", "word", "part")
    alone = F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), F.col("word"), F.lit(r"\E(?![A-Za-z0-9_$])"))
    texts = frontier.select("seq", F.decode("code", "UTF-8").alias("text"))
    matched = among(held, keep(odd.select("word", "part").distinct()), "part", "inner").join(texts, "seq").where(F.regexp_like("text", alone))
    by_pattern = odd.join(matched.groupBy("word").agg(F.min("seq").alias("source_seq")), "word").select("symbol_id", "source_seq")
    return hits.where(plain).select("symbol_id", "source_seq").union(by_pattern).groupBy("symbol_id").agg(F.min("source_seq").alias("source_seq"))


def expand(items: DataFrame, symbols: DataFrame, files: DataFrame, level: int, budget: int, keep=None) -> DataFrame:
    """items and what their code refers to, `level` steps far. Each symbol is included once, by its first referrer.

    items: spent (seq, code, truncated, ...). keep: writes a table and reads it again (plans would double with each level).
    Symbols and files are read for every level, and only rows that a level needs are kept or shuffled.
    """
    keep = keep or materialised
    for step in range(level):
        items = keep(items)
        frontier = items.where((F.col("level") == step) & (F.octet_length("code") > 0))
        seen = items.select("symbol_id").distinct()
        first = keep(first_references(frontier, symbols, keep).join(seen, "symbol_id", "left_anti"))
        sources = frontier.select(F.col("seq").alias("source_seq"), F.col("qualified_name").alias("source_qualified_name"))
        new = among(symbols, first, "symbol_id", "inner").join(sources, "source_seq")
        order = W.orderBy("source_seq", F.desc(F.length("name")), "qualified_name", "relative_path", "symbol_id")
        base = items.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("base"), F.coalesce(F.sum("taken"), F.lit(0)).alias("used"))
        new = new.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(base))  # one row
        new = new.withColumns(
            {"seq": F.col("base") + F.col("place"), "requested_symbol": F.col("name"), "level": F.lit(step + 1), "related": F.lit(True), "relation_type": F.lit("referenced_by_level")}
        )
        left = F.greatest(F.lit(0).cast("long"), F.lit(budget) - F.col("used"))
        coded = with_code(new.select(*ITEM, "used"), files, keep)
        items = items.unionByName(spend(coded, left).drop("used"))
    return items


def context(
    symbols: DataFrame, files: DataFrame, requested: list[str], partial: bool = False, budget: int = 60000, level: int = 0, relations: DataFrame | None = None, keep=None
) -> DataFrame:
    """The items of a context query with code, taken and truncated. relations: to add related types of the matches."""
    found = find(symbols, requested, partial).withColumns(
        {"level": F.lit(0), "related": F.lit(False), "relation_type": F.lit(""), "source_qualified_name": F.lit("")}
    )
    items = found.select(*ITEM)
    if relations is not None:
        items = items.unionByName(types_of(items, symbols, relations))
    spent = spend(with_code(items, files, (keep or materialised) if level > 0 else None), max(0, budget))
    return expand(spent, symbols, files, level, max(0, budget), keep) if level > 0 else spent


def types_of(items: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Types that the items' relations name, not among the items, each by the first relation that names it."""
    primary = items.groupBy("symbol_id").agg(F.min("seq").alias("primary_seq"), F.first("qualified_name").alias("primary_name"))
    mine = relations.join(primary, relations["source_symbol_id"] == primary["symbol_id"]).select(
        F.col("id").alias("relation_id"), "relation_type", "target_text", "primary_seq", F.col("primary_name").alias("source_qualified_name")
    )
    hits = related_types(mine, symbols).join(items.select(F.col("symbol_id").alias("type_id")).distinct(), "type_id", "left_anti")
    order = W.orderBy("primary_seq", "relation_type", "target_text", "relation_id", "rank")
    placed = hits.withColumn("place", F.row_number().over(order))
    once = placed.withColumn("nth", F.row_number().over(W.partitionBy("type_id").orderBy("place"))).where("nth = 1")
    base = items.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("base"))
    once = once.select("type_id", "place", "relation_type", "source_qualified_name").crossJoin(F.broadcast(base))  # one row
    full = once.join(symbols, once["type_id"] == symbols["symbol_id"])
    return full.withColumns({"seq": F.col("base") + F.col("place"), "requested_symbol": F.col("name"), "level": F.lit(0), "related": F.lit(True)}).select(*ITEM)


def matches_signature(signature: str) -> Column:
    """Direct context: a case-sensitive match without wildcards."""
    q = F.coalesce("qualified_name", F.lit(""))
    return (F.col("name") == signature) | (q == signature) | (F.col("signature") == signature) | F.col("signature").contains(signature) | q.contains(signature)
