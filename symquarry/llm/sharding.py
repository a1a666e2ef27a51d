"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is cut into a fixed number of cells. Each shard owns `vnodes` points on it; a cell belongs to the
first point at or after it, and the distinct shards met clockwise from there are the cell's order of
preference. A row's key (id, checksum and size of its text) hashes to a cell. Every shard has a capacity of
floor(n / shards), the first n mod shards of them one more, so the capacities add up to n: row counts
differ by at most one (law `rows`). A shard first takes the rows of its own cells, in ring order; rows
that find it full continue clockwise, cell after cell, to the first shard with room.

All decisions are made on counts per cell, a table whose size is fixed by the ring and not by the data;
rows only learn their rank inside their cell. Rows that agree in id and content are interchangeable: they
are counted first and dealt out as a run, so many copies of one row do not meet in one task.

Nulls: a null text has size 1 and the checksum of the empty text; a null id is a key like any other. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import counted_out, written

CELLS, VNODES = 4096, 64


def ring(spark, shards: int, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """(cell, prefs): each cell's shards in clockwise order, all of them. A shard's points don't depend on the others."""
    node = F.pmod(F.xxhash64(F.lit("point"), F.col("shard"), F.col("v")), F.lit(cells)).cast("int")
    points = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("v"))
    points = points.select(node.alias("at"), F.xxhash64("v", "shard").alias("tie"), "shard")
    line = points.agg(F.array_sort(F.collect_list(F.struct("at", "tie", "shard"))).alias("points"))
    first = f"""aggregate(points, 0, (n, p) -> if(p.at < cell, n + 1, n))"""
    turned = f"concat(slice(points, {first} + 1, size(points)), slice(points, 1, {first}))"
    return line.select("points", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")).select(
        "cell", F.expr(f"array_distinct(transform({turned}, p -> p.shard))").alias("prefs")
    )


def deal(counts: DataFrame, shards: int, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """(cell, shard, first, len, base): ranks first to first + len - 1 of a cell go to a shard's slots from base on.

    counts: (cell, n). At most 2 * cells + shards rows: each step uses up a cell's rows or a shard's room.
    """
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    sized = ring(spark, shards, vnodes, cells).join(counts, "cell").crossJoin(F.broadcast(total))  # total is one row
    sized = sized.withColumn("home", F.col("prefs")[0])
    room = f"total div {shards} + if(%s < total % {shards}, 1, 0)"
    own = W.partitionBy("home").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sized = sized.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    sized = sized.withColumn("kept", F.expr(f"greatest(0L, least(n, ({room.replace('%s', 'home', 1)}) - before))"))
    whole = sized.agg(
        F.array_sort(F.collect_list(F.struct("cell", "home", "kept", "n", "prefs"))).alias("all"), F.max("total").alias("total")
    )
    free = f"""transform(sequence(0, {shards - 1}), s -> ({room.replace("%s", "s", 1)})
               - aggregate(filter(all, c -> c.home = s), 0L, (a, c) -> a + c.kept))"""
    # state: room left by shard, and what has been dealt; for each overflowing cell, the walk along its shards
    walk = """aggregate(slice(c.prefs, 2, size(c.prefs)), named_struct('left', c.n - c.kept, 'free', st.free, 'out', st.out), (w, s) ->
        if(w.left = 0 or w.free[s] = 0, w, named_struct(
            'left', w.left - least(w.left, w.free[s]),
            'free', transform(w.free, (f, i) -> if(i = s, f - least(w.left, f), f)),
            'out', concat(w.out, array(named_struct('cell', c.cell, 'shard', s, 'first', c.n - w.left, 'len', least(w.left, w.free[s])))))))"""
    folded = whole.withColumn("room", F.expr(free)).withColumn(
        "moved",
        F.expr(f"""aggregate(filter(all, c -> c.n > c.kept),
            named_struct('free', room, 'out', cast(array() as array<struct<cell:int,shard:int,first:bigint,len:bigint>>)),
            (st, c) -> transform(array({walk}), w -> named_struct('free', w.free, 'out', w.out))[0]).out"""),
    )
    runs = folded.select(
        F.expr("concat(transform(filter(all, c -> c.kept > 0), c -> named_struct('step', 0, 'cell', c.cell, 'shard', c.home, 'first', 0L, 'len', c.kept)), "
               "transform(moved, m -> named_struct('step', 1, 'cell', m.cell, 'shard', m.shard, 'first', m.first, 'len', m.len)))").alias("runs")
    )
    runs = runs.select(F.inline("runs"))
    ahead = W.partitionBy("shard").orderBy("step", "cell").rowsBetween(W.unboundedPreceding, -1)
    return runs.select("cell", "shard", "first", "len", F.coalesce(F.sum("len").over(ahead), F.lit(0)).alias("base"))


def shard(docs: DataFrame, shards: int = 16, text: str = "text", id_col: str = "doc_id", vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row for each row of docs."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32")
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    spot = F.xxhash64("doc_id", "text_crc32", "size")
    rows = written(rows.withColumn("spot", spot).withColumn("cell", F.pmod("spot", F.lit(cells)).cast("int")), "sharding-rows")
    runs = written(deal(rows.groupBy("cell").agg(F.sum("n").alias("n")), shards, vnodes, cells), "sharding-runs")
    inside = W.partitionBy("cell").orderBy("spot", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranked = counted_out(ranked, "start", "n", "rank")
    placed = ranked.join(F.broadcast(runs), "cell").where("rank >= first and rank < first + len")  # runs: bounded by the ring
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr("base + rank - first").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


def op4_ring_shards(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
