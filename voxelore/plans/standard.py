"""The standard scene from the driver's tables, as far as each query needs it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelore.operators import classify, density, edges, features
from voxelore.operators.scene import Grid, make_grid, scene_from_embeddings
from voxelore.plans.store import written

#: name: (density_high, dilation steps)
VARIANTS = {"std": (500.0, 0), "dilated": (500.0, 1), "adaptive": (0.5, 0)}

#: Fixed start and goal points: qid, start, goal.
QUERIES = [
    (0, -0.35, -0.35, 0.30, 0.35, 0.30, 0.20),
    (1, 0.35, -0.35, -0.10, -0.35, 0.35, 0.10),
    (2, -0.40, 0.00, 0.35, 0.40, 0.05, -0.20),
    (3, 0.0, 0.0, 0.0, 0.30, 0.30, 0.30),
    (4, -0.40, -0.40, -0.20, -0.38, -0.40, -0.20),
    (5, 2.0, 2.0, 2.0, 0.0, 0.0, 0.3),
]


@dataclass(frozen=True)
class Scene:
    """Tables of one scene. Voxels, nodes and edges are written to the shared folder when first asked for: several steps read
    them, plans over them stay short, and a lost executor does not lose them."""

    spark: SparkSession
    sf_dir: str
    variant: str = "std"

    @cached_property
    def gaussians(self) -> DataFrame:
        return scene_from_embeddings(self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet"))

    @cached_property
    def grid(self) -> Grid:
        return make_grid(self.gaussians)

    @cached_property
    def density(self) -> DataFrame:
        return density.density_field(self.gaussians, self.grid)

    @cached_property
    def voxels(self) -> DataFrame:
        high, steps = VARIANTS[self.variant]
        found = classify.dilate(classify.classify(self.density, high), steps)
        return written(classify.floor_filter(found, self.grid), "scene-voxels")

    @cached_property
    def around(self) -> DataFrame:
        return written(classify.neighbourhood(self.voxels), "scene-around")

    @cached_property
    def nodes(self) -> DataFrame:
        return written(edges.with_uid(features.node_features(self.around, self.gaussians, self.grid)), "scene-nodes")

    @cached_property
    def stencil(self) -> DataFrame:
        return edges.stencil_edges(self.nodes, self.grid)

    @cached_property
    def hetero(self) -> DataFrame:
        return written(edges.hetero_edges(self.stencil), "scene-hetero")

    @cached_property
    def unified(self) -> DataFrame:
        return written(edges.unified_edges(self.hetero, self.nodes), "scene-unified")

    @cached_property
    def queries(self) -> DataFrame:
        return self.spark.createDataFrame(QUERIES, "qid long, s_x double, s_y double, s_z double, g_x double, g_y double, g_z double")

    @cached_property
    def points(self) -> DataFrame:
        """Starts (pid = 2 qid) and goals (pid = 2 qid + 1)."""
        side = lambda p, k: self.queries.select((2 * F.col("qid") + k).alias("pid"), *[F.col(f"{p}_{a}").alias(a) for a in "xyz"])
        return side("s", 0).unionByName(side("g", 1))

    @cached_property
    def adjacency(self) -> DataFrame:
        from voxelore.operators import paths

        penalty = paths.obstacle_penalty(self.unified, self.nodes, self.voxels, self.grid)
        return written(edges.adjacency(self.unified, self.nodes).join(penalty, ["src", "dst"]), "scene-adjacency")


@lru_cache(maxsize=8)
def _scene(application: str, sf_dir: str, variant: str) -> Scene:
    return Scene(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), sf_dir, variant)


def scene(spark: SparkSession, sf_dir: str, variant: str = "std") -> Scene:
    """One scene object for each application, folder and variant, so that its kept tables are shared by the queries."""
    return _scene(spark.sparkContext.applicationId, sf_dir, variant)
