"""Snapping, heuristics, edge penalties and shortest paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelore.functions.columns import distance
from voxelore.operators.features import offsets, shifted
from voxelore.operators.scene import OCCUPIED, Grid
from voxelore.plans.store import new_path, remove, written

WARN_SNAP, MAX_SNAP = 0.15, 0.35


def snap(points: DataFrame, nodes: DataFrame, grid: Grid) -> DataFrame:
    """points(pid, x, y, z) -> pid, uid, d of the nearest node, ties by unified id.

    Only the points' few columns are broadcast, and only if adaptive execution finds them small; every node then meets
    every point once, and the minimum combines in the tasks. Points beyond the warning distance snap as well.
    """
    p = points.select("pid", *[F.col(k).alias(f"p_{k}") for k in "xyz"])
    pairs = nodes.select("uid", "x", "y", "z").join(p, on=F.lit(True), how="inner")
    pairs = pairs.select("pid", "uid", distance("", "p").alias("d"))
    return pairs.groupBy("pid").agg(F.min(F.struct("d", "uid")).alias("best")).select("pid", F.col("best.uid").alias("uid"), F.col("best.d").alias("d"))


def snap_status(d: Column) -> Column:
    return F.when(d > MAX_SNAP, "fail").when(d > WARN_SNAP, "warn").otherwise("ok")


def cost_scale(hetero: DataFrame, voxel_size: float) -> DataFrame:
    """One row: the median over edge types of the median weight per length."""
    per = hetero.where(F.col("d") > 1e-6).groupBy("src_type", "rel", "dst_type").agg(F.median(F.col("w") / F.col("d")).alias("m"))
    found = per.where((F.col("m") > 0) & (F.col("m") < float("inf"))).agg(F.median("m").alias("m"))
    return found.select(F.coalesce("m", F.lit(1 / (math.sqrt(3) * voxel_size) if voxel_size > 0 else 1.0)).alias("scale"))


def segment_distance(p: str, a: str, b: str) -> Column:
    """From a point to the segment between two others, by column prefixes."""
    at = lambda q, k: F.col(f"{q}_{k}" if q else k)
    ab = {k: at(b, k) - at(a, k) for k in "xyz"}
    len2 = sum(v * v for v in ab.values())
    t = F.when(len2 < 1e-12, 0.0).otherwise(F.least(F.greatest(sum((at(p, k) - at(a, k)) * ab[k] for k in "xyz") / len2, F.lit(0.0)), F.lit(1.0)))
    return F.sqrt(sum((at(p, k) - at(a, k) - t * ab[k]) ** 2 for k in "xyz"))


def heuristic(nodes: DataFrame, queries: DataFrame, scale: DataFrame, alpha: float = 1.0, line_bias: float = 0.0, uncertain: bool = True) -> DataFrame:
    """(qid, uid, h) for queries(qid, s_x .. g_z): distance to the goal in cost units, the line term and the uncertainty terms."""
    if not uncertain:
        nodes = nodes.withColumns({"f9": F.lit(1.0), "f11": F.lit(0.0)})
    rows = nodes.join(queries, on=F.lit(True), how="inner").crossJoin(F.broadcast(scale))  # one row
    h = distance("", "g") * F.col("scale")
    if line_bias > 0:
        h = h + line_bias * segment_distance("", "s", "g") / F.greatest(distance("s", "g"), F.lit(1e-3))
    h = h + alpha * (1 - F.col("f9")) + 0.5 * F.col("f11")
    return rows.select("qid", "uid", F.greatest(h, F.lit(0.0)).alias("h"))


def _samples(edges: DataFrame, m: Column) -> DataFrame:
    """A row for each of m evenly spaced points of an edge, ends included: p_x, p_y, p_z."""
    out = edges.withColumn("m", m).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    t = F.col("s") / (F.col("m") - 1)
    return out.withColumns({f"p_{k}": F.col(f"a_{k}") + t * (F.col(f"b_{k}") - F.col(f"a_{k}")) for k in "xyz"})


def edge_ends(unified: DataFrame, nodes: DataFrame) -> DataFrame:
    at = lambda side, p: nodes.select(F.col("uid").alias(side), *[F.col(k).alias(f"{p}_{k}") for k in "xyz"])
    return unified.join(at("src", "a"), "src").join(at("dst", "b"), "dst").withColumn("len", distance("a", "b"))


def _nearest_obstacle(samples: DataFrame, keys: list[str], voxels: DataFrame, grid: Grid, reach: float) -> DataFrame:
    """Samples with `near`, the distance to the nearest OCCUPIED centre, where it is at most `reach`.

    Candidates are found once for each cell: the nearest obstacle of any point in a cell is no farther from the cell's
    centre than the centre's own nearest plus one diagonal. Samples then join the few candidates of their cell.
    """
    cells = {f"i{k}": F.floor((F.col(f"p_{k}") - lo) / c).cast("long") for k, lo, c in zip("xyz", grid.lower, grid.cell, strict=True)}
    at = ["ix", "iy", "iz"]
    own = samples.withColumns(cells).select(*keys, "p_x", "p_y", "p_z", *at)
    walls = voxels.where(F.col("node_type") == OCCUPIED).select(*[F.col(f"i{k}").alias(f"j{k}") for k in "xyz"], *[F.col(k).alias(f"o_{k}") for k in "xyz"])
    around = shifted(own.select(*at).distinct(), offsets(grid, reach + grid.diag), grid).join(walls, ["jx", "jy", "jz"])
    around = around.withColumn("least", F.min("d").over(W.partitionBy(*at))).where(F.col("d") <= F.col("least") + grid.diag * (1 + 1e-9))
    hit = own.join(around.select(*at, "o_x", "o_y", "o_z"), at).withColumn("d", distance("p", "o")).where(F.col("d") <= reach)
    return hit.groupBy(*keys).agg(F.min("d").alias("near"))


def obstacle_penalty(unified: DataFrame, nodes: DataFrame, voxels: DataFrame, grid: Grid, weight: float = 3.0, sigma_scale: float = 2.0) -> DataFrame:
    """(src, dst, penalty): the soft obstacle term of each edge.

    A sample farther than 6 sigma from all obstacles adds under 3e-16, so that looking no farther is exact to the last bits.
    """
    r = grid.robot_radius
    step, sigma = max(min(0.02, max(r / 2, 1e-4)), 1e-4), max(r * sigma_scale, 1e-4)
    ends = edge_ends(unified, nodes)
    m = F.least(F.lit(32), F.greatest(F.lit(4), F.ceil(F.col("len") / step) + 1)).cast("int")
    samples = _samples(ends, m)
    near = _nearest_obstacle(samples, ["src", "dst", "s"], voxels, grid, 6 * sigma)
    total = near.groupBy("src", "dst").agg(F.sum(F.exp(-((F.col("near") / sigma) ** 2))).alias("total"))
    out = ends.withColumn("m", m).join(total, ["src", "dst"], "left")
    mean = F.coalesce("total", F.lit(0.0)) / F.col("m")
    value = weight * mean * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("len") / sigma))
    return out.select("src", "dst", F.when(F.col("len") < 1e-9, 0.0).otherwise(value).alias("penalty"))


def segment_clear(unified: DataFrame, nodes: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """(src, dst, clear): no sample nearer to an obstacle than 1.05 robot radii."""
    r = grid.robot_radius
    ends = edge_ends(unified, nodes)
    m = F.least(F.lit(64), F.greatest(F.lit(8), F.ceil(F.col("len") / (r / 2)))).cast("int")
    near = _nearest_obstacle(_samples(ends, m), ["src", "dst", "s"], voxels, grid, r * 1.05)
    hit = near.where(F.col("near") < r * 1.05).select("src", "dst").distinct().withColumn("hit", F.lit(True))
    return ends.join(hit, ["src", "dst"], "left").select("src", "dst", F.col("hit").isNull().alias("clear"))


def shortest_costs(edges: DataFrame, goals: DataFrame, reverse: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """edges(src, dst, w), goals(goal) -> (goal, node, cost) for all nodes reached, all goals in one fixpoint.

    Costs run along the edges from the goal, as the reference semantics have it; `reverse` gives costs to the goal. Only
    rows that improved go on to the next round, and each round is written to the shared folder. More than max_rounds is an error.
    """
    spark = edges.sparkSession
    e = edges.select(*[F.col(c).alias(n) for c, n in zip(("dst", "src") if reverse else ("src", "dst"), ("a", "b"), strict=True)], "w")
    known_path = new_path(spark, "sssp")
    known = written(goals.select("goal", F.col("goal").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")), "sssp", known_path)
    for _ in range(max_rounds):
        reached = known.where("fresh").join(e, F.col("node") == F.col("a")).groupBy("goal", F.col("b").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("via"))
        both = known.drop("fresh").join(reached, ["goal", "node"], "full")
        better = F.col("via").isNotNull() & (F.col("cost").isNull() | (F.col("via") < F.col("cost")))
        at = new_path(spark, "sssp")
        known = written(both.select("goal", "node", F.when(better, F.col("via")).otherwise(F.col("cost")).alias("cost"), better.alias("fresh")), "sssp", at)
        remove(spark, known_path)
        known_path = at
        if known.where("fresh").isEmpty():
            return known.drop("fresh")
    raise RuntimeError(f"costs did not settle in {max_rounds} rounds")


def missing_goals(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Goals without costs in the cache, each once."""
    return wanted.select("goal").distinct().join(cache.select("goal").distinct(), "goal", "left_anti")


def cached_costs(edges: DataFrame, wanted: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Costs of the wanted goals; only those missing from the cache are solved."""
    if cache is None:
        return shortest_costs(edges, wanted.select("goal").distinct())
    return cache.unionByName(shortest_costs(edges, missing_goals(wanted, cache)))


def path_profile(paths: DataFrame, z_slope: float = 1.5, z_curvature: float = 1.8) -> DataFrame:
    """paths(qid, seq, x, y, z) with the slope and curvature penalties at each point that has two before it."""


    w = W.partitionBy("qid").orderBy("seq")
    z0, z1, z2 = F.lag("z", 2).over(w), F.lag("z", 1).over(w), F.col("z")
    return paths.withColumns({"slope": z_slope * (F.abs(z1 - z0) + F.abs(z2 - z1)), "curvature": z_curvature * F.abs(z2 - 2 * z1 + z0)})


def materialise(path_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """path_nodes(qid, seq, uid) with coordinates; points under 1e-6 from the one before go."""


    w = W.partitionBy("qid").orderBy("seq")
    out = path_nodes.join(nodes.select("uid", "node_type", "local_id", "x", "y", "z"), "uid")
    out = out.withColumns({f"b_{k}": F.lag(k).over(w) for k in "xyz"})
    return out.where(F.col("b_x").isNull() | (distance("", "b") >= 1e-6)).drop("b_x", "b_y", "b_z")


