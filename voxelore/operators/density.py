"""Density and its gradient as truncated sums over Gaussians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelore.functions.columns import steady_sum
from voxelore.operators.scene import Grid, centers, with_inverse

LIMIT, TRUNCATION = 1e6, 3.0


def _weight(floor: float) -> Column:
    return F.coalesce(F.col("opacity"), F.lit(1.0)) / F.sqrt(F.lit((2 * math.pi) ** 3) * F.greatest("det", F.lit(floor)))


def weighted(gaussians: DataFrame) -> DataFrame:
    """Adds the inverse, the clamped weight of the density, the gradient's own weight and the reach hx, hy, hz of a Gaussian."""
    out = with_inverse(gaussians)
    out = out.withColumns({"w": F.least(_weight(1e-12), F.lit(LIMIT)), "wg": _weight(1e-30)})
    return out.withColumns({f"h{k}": TRUNCATION * F.sqrt(F.col(k + k)) for k in "xyz"})


def _d2() -> Column:
    x, y, z = F.col("dx"), F.col("dy"), F.col("dz")
    return x * x * F.col("ixx") + y * y * F.col("iyy") + z * z * F.col("izz") + 2 * (x * y * F.col("ixy") + x * z * F.col("ixz") + y * z * F.col("iyz"))


def grid_pairs(gaussians: DataFrame, grid: Grid) -> DataFrame:
    """Gaussians with the voxels whose centres they reach (d2 < 9).

    The voxels under a Gaussian's box follow from the grid, so rows are generated and no theta join runs; wide Gaussians
    only make more rows, in the task that holds them.
    """
    out = weighted(gaussians)
    for k, lo, c, r in zip("xyz", grid.lower, grid.cell, grid.res, strict=True):
        first = F.greatest(F.ceil((F.col(k) - F.col(f"h{k}") - lo) / c - 0.5), F.lit(0)).cast("long")
        last = F.least(F.floor((F.col(k) + F.col(f"h{k}") - lo) / c - 0.5), F.lit(r - 1)).cast("long")
        out = out.withColumns({"first": first, "last": last}).where("first <= last").withColumn(f"i{k}", F.explode(F.sequence("first", "last")))
        out = out.withColumn(f"d{k}", F.lit(lo) + (F.col(f"i{k}") + 0.5) * F.lit(c) - F.col(k))
    vid = (F.col("ix") * grid.res[1] + F.col("iy")) * grid.res[2] + F.col("iz")
    return out.withColumns({"vid": vid, "d2": _d2()}).where(F.col("d2") < TRUNCATION**2)


def _sums() -> list[Column]:
    kernel = F.exp(-0.5 * F.col("d2"))
    pull = {
        "x": F.col("ixx") * F.col("dx") + F.col("ixy") * F.col("dy") + F.col("ixz") * F.col("dz"),
        "y": F.col("ixy") * F.col("dx") + F.col("iyy") * F.col("dy") + F.col("iyz") * F.col("dz"),
        "z": F.col("ixz") * F.col("dx") + F.col("iyz") * F.col("dy") + F.col("izz") * F.col("dz"),
    }
    return [steady_sum(F.col("w") * kernel).alias("rho"), *[steady_sum(-F.col("wg") * kernel * c).alias(f"g{k}") for k, c in pull.items()]]


def density_field(gaussians: DataFrame, grid: Grid) -> DataFrame:
    """All voxels with rho; sums combine in the tasks before the shuffle on the voxel."""
    rho = grid_pairs(gaussians, grid).groupBy("vid").agg(_sums()[0])
    out = centers(gaussians.sparkSession, grid).join(rho, "vid", "left")
    return out.withColumn("rho", F.least(F.coalesce("rho", F.lit(0.0)), F.lit(LIMIT)))


def gradient_field(gaussians: DataFrame, grid: Grid) -> DataFrame:
    sums = grid_pairs(gaussians, grid).groupBy("vid").agg(*_sums()[1:])
    out = centers(gaussians.sparkSession, grid).join(sums, "vid", "left")
    return out.withColumns({f"g{k}": F.coalesce(f"g{k}", F.lit(0.0)) for k in "xyz"})


def at_points(gaussians: DataFrame, points: DataFrame, bucket: float = 0.3) -> DataFrame:
    """points(pid, x, y, z) with rho and gx, gy, gz, by an equi-join on coarse cells."""
    own = points.select("pid", *[F.col(k).alias(f"p{k}") for k in "xyz"], *[F.floor(F.col(k) / bucket).alias(f"c{k}") for k in "xyz"])
    reach = weighted(gaussians)
    for k in "xyz":
        reach = reach.withColumn(f"c{k}", F.explode(F.sequence(F.floor((F.col(k) - F.col(f"h{k}")) / bucket), F.floor((F.col(k) + F.col(f"h{k}")) / bucket))))
    pairs = own.join(reach, ["cx", "cy", "cz"]).withColumns({f"d{k}": F.col(f"p{k}") - F.col(k) for k in "xyz"})
    sums = pairs.withColumn("d2", _d2()).where(F.col("d2") < TRUNCATION**2).groupBy("pid").agg(*_sums())
    out = points.join(sums, "pid", "left")
    return out.withColumns({"rho": F.least(F.coalesce("rho", F.lit(0.0)), F.lit(LIMIT)), **{f"g{k}": F.coalesce(f"g{k}", F.lit(0.0)) for k in "xyz"}})
