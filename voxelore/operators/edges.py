"""Neighbourhood edges, kNN edges, the typed graph and its views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelore.operators.features import offsets, shifted
from voxelore.operators.scene import FREE, FRONTIER, Grid

LAMBDA_DIST, LAMBDA_CONF, LAMBDA_OBS, NEIGHBOURS = 0.5, 0.3, 0.2, 6
NAMES = {FREE: "free", FRONTIER: "frontier"}


def stencil(grid: Grid) -> list[tuple[int, int, int, float]]:
    """The 26 non-zero offsets with their lengths."""
    cx, cy, cz = grid.cell
    return [(i, j, k, math.sqrt((i * cx) ** 2 + (j * cy) ** 2 + (k * cz) ** 2)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]


def _weight(grid: Grid, obs: Column) -> Column:
    return LAMBDA_DIST * F.col("d") / grid.diag + LAMBDA_CONF * (1 - (F.col("s_conf") + F.col("t_conf")) / 2) + LAMBDA_OBS * obs


def _ends(nodes: DataFrame, prefix: str, *more: str) -> DataFrame:
    cols = {"plan_idx": "idx", "local_id": "local", "node_type": "type", "f9": "conf", "obs_ratio": "obs"}
    return nodes.select(*more, *[F.col(c).alias(f"{prefix}_{n}") for c, n in cols.items()])


def _met(nodes: DataFrame, steps: list, grid: Grid) -> DataFrame:
    """Pairs of nodes that one of the offsets joins, by an equi-join on the cell."""
    source = shifted(_ends(nodes, "s", "ix", "iy", "iz"), steps, grid).drop("ix", "iy", "iz")
    target = _ends(nodes, "t", *[F.col(f"i{k}").alias(f"j{k}") for k in "xyz"])
    return source.join(target, ["jx", "jy", "jz"]).drop("jx", "jy", "jz")


def stencil_edges(nodes: DataFrame, grid: Grid) -> DataFrame:
    """All directed edges between 26-neighbours: s_*, t_*, d and w, which uses the source's obstacle ratio."""
    return _met(nodes, stencil(grid), grid).withColumn("w", _weight(grid, F.col("s_obs")))


def knn_edges(nodes: DataFrame, grid: Grid, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest nodes of each under 3 cell diagonals, ties by plan index.

    A node with k neighbours among its 26 is done, if the next ring is farther than they are; the others look as far as
    the bound. The obstacle ratio is the mean of both ends.
    """
    nearest = W.partitionBy("s_idx").orderBy("d", "t_idx")
    ring = _met(nodes, stencil(grid), grid)
    if 2 * min(grid.cell) > grid.diag:
        enough = ring.groupBy("s_idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("s_idx")
        done = ring.join(enough, "s_idx", "left_semi")
        rest = nodes.join(enough.withColumnRenamed("s_idx", "plan_idx"), "plan_idx", "left_anti")
    else:
        done, rest = ring.where("false"), nodes
    wide = [o for o in offsets(grid, 3 * grid.diag) if o[3] > 0]
    source = shifted(_ends(rest, "s", "ix", "iy", "iz"), wide, grid).drop("ix", "iy", "iz")
    far = source.join(_ends(nodes, "t", *[F.col(f"i{a}").alias(f"j{a}") for a in "xyz"]), ["jx", "jy", "jz"]).drop("jx", "jy", "jz")
    found = done.unionByName(far).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return found.withColumn("w", _weight(grid, (F.col("s_obs") + F.col("t_obs")) / 2))


def hetero_edges(edges: DataFrame) -> DataFrame:
    """(src_type, rel, dst_type, src, dst, w, d) of the four edge types, in one pass.

    Frontier-to-free edges are the free-to-frontier ones turned round with the same weight; those that the stencil itself
    finds from the frontier's side are left out.
    """
    def ends(a: str, b: str) -> Column:
        name = lambda side: F.when(F.col(f"{side}_type") == FREE, NAMES[FREE]).otherwise(NAMES[FRONTIER])
        return F.struct(name(a).alias("src_type"), name(b).alias("dst_type"), F.col(f"{a}_local").alias("src"), F.col(f"{b}_local").alias("dst"))

    mixed = (F.col("s_type") == FREE) & (F.col("t_type") == FRONTIER)
    rows = edges.where(~((F.col("s_type") == FRONTIER) & (F.col("t_type") == FREE)))
    rows = rows.withColumn("e", F.explode(F.when(mixed, F.array(ends("s", "t"), ends("t", "s"))).otherwise(F.array(ends("s", "t")))))
    both = (F.col("e.src_type") == NAMES[FRONTIER]) & (F.col("e.dst_type") == NAMES[FRONTIER])
    return rows.select("e.src_type", F.when(both, "connects").otherwise("spatial").alias("rel"), "e.dst_type", "e.src", "e.dst", "w", "d")


def with_uid(nodes: DataFrame) -> DataFrame:
    """Adds uid: free nodes keep their local id, frontier nodes follow them."""
    n_free = nodes.where(F.col("node_type") == FREE).agg(F.count(F.lit(1)).alias("n_free"))
    out = nodes.crossJoin(F.broadcast(n_free))  # one row
    return out.withColumn("uid", F.when(F.col("node_type") == FREE, F.col("local_id")).otherwise(F.col("n_free") + F.col("local_id"))).drop("n_free")


def unified_edges(hetero: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w, d) over unified ids, all types together."""
    n_free = nodes.where(F.col("node_type") == FREE).agg(F.count(F.lit(1)).alias("n_free"))
    shift = lambda side: F.col(side) + F.when(F.col(f"{side}_type") == NAMES[FRONTIER], F.col("n_free")).otherwise(0)
    return hetero.crossJoin(F.broadcast(n_free)).select(shift("src").alias("src"), shift("dst").alias("dst"), "w", "d")


def adjacency(unified: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w, len, dz): edges with their geometry."""
    at = lambda p: nodes.select(F.col("uid").alias(p), *[F.col(k).alias(f"{p}_{k}") for k in "xyz"])
    out = unified.join(at("src"), "src").join(at("dst"), "dst")
    length = F.sqrt(sum((F.col(f"src_{k}") - F.col(f"dst_{k}")) ** 2 for k in "xyz"))
    return out.select("src", "dst", "w", length.alias("len"), F.abs(F.col("src_z") - F.col("dst_z")).alias("dz"))


def graph_stats(nodes: DataFrame, hetero: DataFrame) -> DataFrame:
    """(name, n): nodes by type and edges by type."""
    a = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("nodes_"), F.when(F.col("node_type") == FREE, "free").otherwise("frontier")).alias("name"), "n")
    b = hetero.groupBy("src_type", "rel", "dst_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws("_", F.lit("edges"), "src_type", "rel", "dst_type").alias("name"), "n")
    return a.unionByName(b)


def legacy_view(nodes: DataFrame) -> DataFrame:
    """The flat view: features whose first three are world coordinates."""
    return nodes.withColumns({"f0": F.col("x"), "f1": F.col("y"), "f2": F.col("z")})
