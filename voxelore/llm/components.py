"""Connected components by alternating large-star and small-star steps, every step a shuffle on node keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelore.llm.store import new_path, remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(u, v) of longs -> (node, root): the least node that each linked node can reach; unlinked nodes don't appear.

    Each round is written to the shared folder, so that lineage stays short and a lost executor costs one round at most.
    No step gathers a component in one task: hubs only take part in minima, which combine before the shuffle, and in joins
    that adaptive execution can split. Null ends and self links are ignored; no links give an empty result.
    """
    spark = links.sparkSession
    edges = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    path = new_path(spark, "cc")
    edges = written(edges, "cc", path)
    was = _state(edges)
    for _ in range(max_rounds):
        if not was[0]:
            break
        at = new_path(spark, "cc")
        edges = written(_small_star(_large_star(edges)), "cc", at)
        remove(spark, path)
        path, now = at, _state(edges)
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        was = now
    if was[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
