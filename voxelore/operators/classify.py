"""Voxel classes, dilation, uncertainty, and the box sums they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelore.functions.columns import finite
from voxelore.operators.scene import FREE, FRONTIER, OCCUPIED, UNKNOWN, Grid


def box(voxels: DataFrame, values: dict[str, Column], how=F.sum, reach: int = 1) -> DataFrame:
    """Adds for each name the sum (or maximum) of the value over the cube of 2 * reach + 1 cells; the grid's edge cuts it.

    Separable: one range window for each axis, whatever the number of values.
    """
    out = voxels.withColumns(values)
    for axis, others in (("ix", ("iy", "iz")), ("iy", ("ix", "iz")), ("iz", ("ix", "iy"))):
        w = W.partitionBy(*others).orderBy(axis).rangeBetween(-reach, reach)
        out = out.withColumns({k: how(k).over(w) for k in values})
    return out


def thresholds(voxels: DataFrame, high: float) -> DataFrame:
    """One row (adapts, low, high): quantiles of the positive densities where the fixed threshold leaves a class empty."""
    rho = F.when(finite("rho"), F.col("rho"))
    positive = F.when(rho > 0, F.least(rho, F.lit(1e6)))
    t = voxels.agg(
        F.count_if(rho > 0).alias("n"), F.count_if((rho > 0) & (rho <= high)).alias("below"), F.count_if(rho > high).alias("above"),
        F.percentile(positive, F.array(F.lit(0.3), F.lit(0.7))).alias("q"),
    )
    adapts = (F.col("n") > 0) & ((F.col("below") == 0) | (F.col("above") == 0))
    low, top = F.get("q", 0), F.get("q", 1)
    return t.select(adapts.alias("adapts"), low.alias("low"), F.when(top <= low, 2 * low).otherwise(top).alias("high"))


def classify(voxels: DataFrame, high: float, adaptive: bool = True) -> DataFrame:
    """Adds node_type. Negative and non-finite densities are UNKNOWN."""
    top: Column = F.lit(high)
    if adaptive:
        t = thresholds(voxels, high).select(F.when(F.col("adapts"), F.col("high")).otherwise(F.lit(high)).alias("tau_high"))
        voxels, top = voxels.crossJoin(F.broadcast(t)), F.col("tau_high")  # one row
    kind = F.when(~finite("rho"), UNKNOWN).when(F.col("rho") > top, OCCUPIED).when(F.col("rho") == 0, FREE).when(F.col("rho") > 0, FRONTIER).otherwise(UNKNOWN)
    return voxels.withColumn("node_type", kind.cast("int")).drop("tau_high")


def dilate(voxels: DataFrame, steps: int) -> DataFrame:
    """FREE and FRONTIER voxels within `steps` cells of an OCCUPIED one turn OCCUPIED; UNKNOWN stays."""
    if steps <= 0:
        return voxels
    near = box(voxels, {"near": (F.col("node_type") == OCCUPIED).cast("int")}, F.max, steps)
    hit = (F.col("near") == 1) & F.col("node_type").isin(FREE, FRONTIER)
    return near.withColumn("node_type", F.when(hit, OCCUPIED).otherwise(F.col("node_type"))).drop("near")


def floor_filter(voxels: DataFrame, grid: Grid) -> DataFrame:
    return voxels.withColumn("node_type", F.when(F.col("z") <= grid.z_floor, OCCUPIED).otherwise(F.col("node_type")))


def planning(voxels: DataFrame) -> DataFrame:
    return voxels.where(F.col("node_type").isin(FREE, FRONTIER))


def binary_grid(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("non_navigable", F.col("node_type").isin(OCCUPIED, UNKNOWN))


def class_counts(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def variance() -> Column:
    mean = F.col("s27") / F.col("n27")
    return F.greatest(F.col("ss27") / F.col("n27") - mean * mean, F.lit(0.0))


def neighbourhood(voxels: DataFrame) -> DataFrame:
    """Adds n27, s27, ss27 (count, sum and sum of squares of rho), free27 and occ27 over the 27-cell box, in three windows."""
    one = lambda t: (F.col("node_type") == t).cast("long")
    return box(voxels, {"n27": F.lit(1).cast("long"), "s27": F.col("rho"), "ss27": F.col("rho") * F.col("rho"), "free27": one(FREE), "occ27": one(OCCUPIED)})


def uncertainty(around: DataFrame) -> DataFrame:
    value = F.least(variance() / F.greatest("rho", F.lit(1e-6)), F.lit(1.0))
    return around.withColumn("uncertainty", F.when(F.col("rho") <= 0, 0.0).otherwise(value))


def obstacle_ratio(around: DataFrame) -> DataFrame:
    """OCCUPIED among the 26 neighbours over those inside the grid."""
    own = (F.col("node_type") == OCCUPIED).cast("long")
    return around.withColumn("obs_ratio", (F.col("occ27") - own) / (F.col("n27") - 1))
