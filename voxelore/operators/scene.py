"""Scenes of Gaussian primitives: columns gid, x, y, z, the symmetric covariance xx, xy, xz, yy, yz, zz, opacity, luminance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FREE, FRONTIER, OCCUPIED, UNKNOWN = 0, 1, -1, 2


def _sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-4 * c))


def scene_from_embeddings(embeddings: DataFrame, rotated: bool = False) -> DataFrame:
    """The standard scene: mean, spreads, opacity and colour from the leading dimensions of each vector."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    out = embeddings.select(
        F.col("vec_id").alias("gid"), e(1).alias("x"), e(2).alias("y"), e(3).alias("z"),
        *[(0.02 + 0.1 * F.abs(e(3 + k))).alias(f"s{k}") for k in (1, 2, 3)], *[e(10 + k).alias(f"q{k}") for k in (1, 2, 3, 4)],
        _sigmoid(e(7)).alias("opacity"), ((_sigmoid(e(8)) + _sigmoid(e(9)) + _sigmoid(e(10))) / 3).alias("luminance"),
    )
    if not rotated:
        zero = F.lit(0.0)
        cov = {"xx": F.col("s1") * F.col("s1"), "xy": zero, "xz": zero, "yy": F.col("s2") * F.col("s2"), "yz": zero, "zz": F.col("s3") * F.col("s3")}
        return out.select("gid", "x", "y", "z", *[c.alias(n) for n, c in cov.items()], "opacity", "luminance")
    norm = F.sqrt(sum(F.col(f"q{k}") ** 2 for k in (1, 2, 3, 4)))
    w, i, j, k = (F.col(f"u{n}") for n in (1, 2, 3, 4))
    out = out.withColumns({f"u{n}": F.col(f"q{n}") / norm for n in (1, 2, 3, 4)})
    rot = [[1 - 2 * (j * j + k * k), 2 * (i * j - w * k), 2 * (i * k + w * j)], [2 * (i * j + w * k), 1 - 2 * (i * i + k * k), 2 * (j * k - w * i)], [2 * (i * k - w * j), 2 * (j * k + w * i), 1 - 2 * (i * i + j * j)]]
    cov = {a + b: sum(rot["xyz".index(a)][n] * rot["xyz".index(b)][n] * F.col(f"s{n + 1}") ** 2 for n in range(3)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return out.select("gid", "x", "y", "z", *[c.alias(n) for n, c in cov.items()], "opacity", "luminance")


def determinant() -> Column:
    a, b, c, d, e, f = (F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)


def with_inverse(gaussians: DataFrame) -> DataFrame:
    """Adds det and the inverse covariance ixx .. izz, in closed form."""
    a, b, c, d, e, f = (F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
    minors = {"ixx": d * f - e * e, "ixy": c * e - b * f, "ixz": b * e - c * d, "iyy": a * f - c * c, "iyz": b * c - a * e, "izz": a * d - b * b}
    out = gaussians.withColumn("det", determinant())
    return out.withColumns({k: m / F.col("det") for k, m in minors.items()})


def bounds_filter(points: DataFrame, lower: tuple, upper: tuple) -> DataFrame:
    """Points with all coordinates in [lower, upper]."""
    return points.where(F.col("x").between(lower[0], upper[0]) & F.col("y").between(lower[1], upper[1]) & F.col("z").between(lower[2], upper[2]))


@dataclass(frozen=True)
class Grid:
    """A regular grid. The cell is the extent over the resolution, so it may differ from the voxel size asked for."""

    lower: tuple[float, float, float]
    upper: tuple[float, float, float]
    res: tuple[int, int, int]
    voxel_size: float = 0.08
    robot_radius: float = 0.02

    @property
    def cell(self) -> tuple[float, ...]:
        return tuple((u - lo) / r for lo, u, r in zip(self.lower, self.upper, self.res, strict=True))

    @property
    def diag(self) -> float:
        return sum(c * c for c in self.cell) ** 0.5

    @property
    def z_floor(self) -> float:
        return self.lower[2] + max(self.robot_radius, self.cell[2])

    @property
    def size(self) -> int:
        return self.res[0] * self.res[1] * self.res[2]


def bounds_table(points: DataFrame, voxel_size: float, lower: tuple | None = None, upper: tuple | None = None) -> DataFrame:
    """One row min_x .. max_z, rx, ry, rz: explicit bounds if both are given, else those of the points and two voxels more."""
    if lower is not None and upper is not None:
        box = points.sparkSession.range(1).select(*[F.lit(float(v)).alias(f"{w}_{k}") for w, b in (("min", lower), ("max", upper)) for k, v in zip("xyz", b, strict=True)])
    else:
        pad = 2 * voxel_size
        box = points.agg(*[(F.min(k) - pad).alias(f"min_{k}") for k in "xyz"], *[(F.max(k) + pad).alias(f"max_{k}") for k in "xyz"])
    return box.select("*", *[F.greatest(F.ceil((F.col(f"max_{k}") - F.col(f"min_{k}")) / voxel_size), F.lit(10)).cast("long").alias(f"r{k}") for k in "xyz"])


def make_grid(points: DataFrame, voxel_size: float = 0.08, robot_radius: float = 0.02, lower: tuple | None = None, upper: tuple | None = None) -> Grid:
    """The grid of a scene; one aggregate row comes to the driver."""
    r = bounds_table(points, voxel_size, lower, upper).first()
    if r.min_x is None:
        raise ValueError("a scene without points needs explicit bounds")
    return Grid(tuple(r[f"min_{k}"] for k in "xyz"), tuple(r[f"max_{k}"] for k in "xyz"), tuple(r[f"r{k}"] for k in "xyz"), voxel_size, robot_radius)


def centers(spark, grid: Grid) -> DataFrame:
    """vid, ix, iy, iz and the centre x, y, z of all voxels in row-major order, made where they are used."""
    rx, ry, rz = grid.res
    v = spark.range(grid.size).select(F.col("id").alias("vid"), F.expr(f"id div {ry * rz}").alias("ix"), F.expr(f"(id div {rz}) % {ry}").alias("iy"), F.expr(f"id % {rz}").alias("iz"))
    return v.select("*", *[(F.lit(lo) + (F.col(f"i{k}") + 0.5) * F.lit(c)).alias(k) for k, lo, c in zip("xyz", grid.lower, grid.cell, strict=True)])
