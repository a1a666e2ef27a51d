"""Connected components of an undirected graph of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node that can be reached.

    edges: (u, v), any direction, loops and repeats allowed. Nodes without an edge are not returned.
    Minimum labels with hooking and pointer jumping: rounds grow with the logarithm of the longest path.
    Each round is written to the shared folder, so its joins read two plain tables and Spark can split
    the partitions of a label that most nodes carry.
    """
    spark = edges.sparkSession
    e_path, f_path = new_path(spark, "edges"), new_path(spark, "labels")
    both = edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct()
    e = written(both, "edges", e_path)
    f = written(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels", f_path)
    for _ in range(max_rounds):
        jump = f.join(f.select(F.col("node").alias("label"), F.col("label").alias("up")), "label")
        j_path = new_path(spark, "jumped")
        jump = written(jump.select("node", "label", "up"), "jumped", j_path)
        near = e.join(jump.select(F.col("node").alias("v"), F.col("up").alias("of_v")), "v")
        near = near.join(jump.select(F.col("node").alias("u"), "label"), "u")
        offers = (
            near.select(F.col("u").alias("node"), F.col("of_v").alias("offer"))
            .union(near.select(F.col("label"), F.col("of_v")))
            .union(jump.select("node", F.col("up")))
            .groupBy("node")
            .agg(F.min("offer").alias("offer"))
        )
        n_path = new_path(spark, "labels")
        new = written(
            jump.join(offers, "node").select("node", F.least("label", "up", "offer").alias("label"), F.col("label").alias("was")),
            "labels",
            n_path,
        )
        moved = new.where("label <> was").limit(1).count()
        drop_path(spark, j_path)
        drop_path(spark, f_path)
        f, f_path = new.select("node", "label"), n_path
        if not moved:
            drop_path(spark, e_path)
            return f
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
