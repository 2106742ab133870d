"""The sixteen features of planning nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelore.functions.columns import numbered
from voxelore.operators.classify import obstacle_ratio, planning, variance
from voxelore.operators.scene import FRONTIER, OCCUPIED, Grid

REACH = 0.1


def cell_of(grid: Grid) -> Column:
    """The voxel that holds a point; points outside count to the border."""
    at = [F.least(F.greatest(F.floor((F.col(k) - lo) / c), F.lit(0)), F.lit(r - 1)) for k, lo, c, r in zip("xyz", grid.lower, grid.cell, grid.res, strict=True)]
    return (at[0] * grid.res[1] + at[1]) * grid.res[2] + at[2]


def binned_means(gaussians: DataFrame, grid: Grid) -> DataFrame:
    return gaussians.groupBy(cell_of(grid).cast("long").alias("vid")).agg(F.avg(F.coalesce("opacity", F.lit(1.0))).alias("alpha"), F.avg("luminance").alias("lum"))


def curvature(voxels: DataFrame) -> DataFrame:
    """Adds kx, ky, kz: second differences of rho with the border repeated."""
    for k, others in (("x", ("iy", "iz")), ("y", ("ix", "iz")), ("z", ("ix", "iy"))):
        w = W.partitionBy(*others).orderBy(f"i{k}")
        before, after = F.coalesce(F.lag("rho").over(w), F.col("rho")), F.coalesce(F.lead("rho").over(w), F.col("rho"))
        voxels = voxels.withColumn(f"k{k}", after - 2 * F.col("rho") + before)
    return voxels


def offsets(grid: Grid, reach: float) -> list[tuple[int, int, int, float]]:
    """Cell offsets whose centres lie under `reach`, with their distance."""
    r, (cx, cy, cz) = [int(reach / c) for c in grid.cell], grid.cell
    found = [(i, j, k, math.sqrt((i * cx) ** 2 + (j * cy) ** 2 + (k * cz) ** 2)) for i in range(-r[0], r[0] + 1) for j in range(-r[1], r[1] + 1) for k in range(-r[2], r[2] + 1)]
    return [o for o in found if o[3] < reach]


def shifted(df: DataFrame, steps: list[tuple[int, int, int, float]], grid: Grid) -> DataFrame:
    """A row for each offset that stays on the grid: jx, jy, jz and d. The offsets are a literal array, no join."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(k).cast("long").alias("k"), F.lit(d).alias("d")) for i, j, k, d in steps])
    out = df.withColumn("o", F.explode(each))
    out = out.withColumns({"jx": F.col("ix") + F.col("o.i"), "jy": F.col("iy") + F.col("o.j"), "jz": F.col("iz") + F.col("o.k"), "d": F.col("o.d")}).drop("o")
    return out.where(" and ".join(f"j{k} between 0 and {r - 1}" for k, r in zip("xyz", grid.res, strict=True)))


def obstacle_distance(voxels: DataFrame, grid: Grid) -> DataFrame:
    """(vid, near): the distance to the nearest OCCUPIED centre where it is under REACH, beyond which the feature is 1."""
    near = shifted(voxels.where(F.col("node_type") == OCCUPIED).select("ix", "iy", "iz"), offsets(grid, REACH), grid)
    vid = (F.col("jx") * grid.res[1] + F.col("jy")) * grid.res[2] + F.col("jz")
    return near.groupBy(vid.alias("vid")).agg(F.min("d").alias("near"))


def node_features(around: DataFrame, gaussians: DataFrame, grid: Grid) -> DataFrame:
    """Planning nodes with plan_idx, local_id, uid, obs_ratio and f0 .. f15. `around`: voxels with their neighbourhood sums."""
    full = obstacle_ratio(curvature(around)).withColumn("sigma", F.sqrt(variance()))
    is_node = F.col("node_type").isin(0, 1)
    spread = F.greatest(*[F.abs(F.col(f"k{k}")) for k in "xyz"])
    top = full.agg(F.max("rho").alias("top_rho"), F.max(F.when(is_node, F.col("sigma"))).alias("top_sigma"), F.max(F.when(is_node, spread)).alias("top_k"))
    top = top.crossJoin(gaussians.agg(F.avg(F.coalesce("opacity", F.lit(1.0))).alias("all_alpha")))
    nodes = planning(full).join(binned_means(gaussians, grid), "vid", "left").join(obstacle_distance(around, grid), "vid", "left").crossJoin(F.broadcast(top))  # one row
    p = F.least(F.greatest("rho", F.lit(1e-6)), F.lit(1 - 1e-6))
    confidence = F.when(F.col("rho") > 1e-6, F.greatest(1 - F.least(F.lit(1.0), variance() / F.col("rho")), F.lit(0.0))).otherwise(1.0)
    found = {f"f{n}": (F.col(k) - lo) / max(u - lo, 1e-6) for n, (k, lo, u) in enumerate(zip("xyz", grid.lower, grid.upper, strict=True))}
    found |= {f"f{3 + n}": F.when(F.col("top_k") > 0, F.col(f"k{k}") / F.col("top_k")).otherwise(F.col(f"k{k}")) for n, k in enumerate("xyz")}
    found |= {
        "f6": F.col("rho") / F.greatest("top_rho", F.lit(1e-6)),
        "f7": F.col("sigma") / F.greatest("top_sigma", F.lit(1e-6)),
        "f8": F.coalesce("alpha", 0.5 * F.col("all_alpha")),
        "f9": confidence,
        "f10": -(p * F.log(p) + (1 - p) * F.log(1 - p)) / math.log(2),
        "f11": (F.col("node_type") == FRONTIER).cast("double"),
        "f12": F.coalesce("lum", F.lit(0.5)),
        "f13": F.col("free27") / F.col("n27"),
        "f14": F.col("occ27") / F.lit(26.0),
        "f15": F.coalesce(F.least(10 * F.col("near"), F.lit(1.0)), F.lit(1.0)),
    }
    nodes = nodes.select("vid", "ix", "iy", "iz", "x", "y", "z", "rho", "node_type", "obs_ratio", *[c.cast("double").alias(k) for k, c in found.items()])
    nodes = numbered(numbered(nodes, "vid", "plan_idx"), "vid", "local_id", ["node_type"])
    return nodes


def without_uncertainty(nodes: DataFrame) -> DataFrame:
    """The ablation: full confidence, no information gain, no frontier flag."""
    return nodes.withColumns({"f9": F.lit(1.0), "f10": F.lit(0.0), "f11": F.lit(0.0)})
