"""One query for each operator, over the standard scene. Doubles are returned as whole millionths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelore.functions.columns import quantised as q
from voxelore.operators import classify, corridor, density, edges, features, hashgrid, learning, network, paths, search, training, trajectory
from voxelore.operators.scene import bounds_filter, bounds_table, centers, scene_from_embeddings, with_inverse
from voxelore.plans.standard import QUERIES, scene
from voxelore.plans.store import written
from voxelore.sources import scenes as sources

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def on_scene(f: Callable) -> Callable:
    """Registers f(scene)."""

    def run(spark, d):
        return f(scene(spark, d))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    query(run)
    return f


def _q(*cols: str) -> list:
    return [q(c).alias(c) for c in cols]


@query
def bounds_filter_scene(spark, d):
    return bounds_filter(scene(spark, d).gaussians, (-0.2, -0.2, -0.2), (0.2, 0.2, 0.2)).select("gid", *_q("x", "y", "z"))


@query
def scene_bounds(spark, d):
    t = bounds_table(scene(spark, d).gaussians, 0.08)
    return t.select(*_q("min_x", "min_y", "min_z", "max_x", "max_y", "max_z"), "rx", "ry", "rz")


@query
def grid_centers(spark, d):
    return centers(spark, scene(spark, d).grid).select("vid", "ix", "iy", "iz", *_q("x", "y", "z"))


@query
def covariance_inverse(spark, d):
    g = scene_from_embeddings(spark.read.parquet(f"{d}/embeddings.parquet"), rotated=True)
    g = with_inverse(g)
    return g.select("gid", q("det", 1e12).alias("det"), *[q(c, 1e3).alias(c) for c in ("ixx", "ixy", "ixz", "iyy", "iyz", "izz")])


@query
def density_field(spark, d):
    return scene(spark, d).density.select("vid", *_q("rho"))


@query
def density_gradient(spark, d):
    s = scene(spark, d)
    return density.gradient_field(s.gaussians, s.grid).select("vid", *[q(f"g{k}", 1e3).alias(f"g{k}") for k in "xyz"])


@on_scene
def density_at_points(s):
    """At the means of all Gaussians, moved by 0.01."""
    g = s.gaussians
    points = g.select(F.col("gid").alias("pid"), *[(F.col(k) + 0.01).alias(k) for k in "xyz"])
    return density.at_points(g, points).select("pid", *_q("rho"), *[q(f"g{k}", 1e3).alias(f"g{k}") for k in "xyz"])


@query
def classify_fixed(spark, d):
    return classify.classify(scene(spark, d).density, 500.0, adaptive=False).select("vid", "node_type")


@query
def adaptive_thresholds(spark, d):
    return classify.thresholds(scene(spark, d).density, 0.5).select("adapts", *_q("low", "high"))


@query
def classify_adaptive(spark, d):
    return classify.classify(scene(spark, d).density, 0.5).select("vid", "node_type")


@query
def dilate_occupied(spark, d):
    return classify.dilate(classify.classify(scene(spark, d).density, 500.0), 1).select("vid", "node_type")


@query
def floor_filter(spark, d):
    return scene(spark, d).voxels.select("vid", "node_type")


@query
def planning_mask(spark, d):
    return classify.planning(scene(spark, d).voxels).select("vid", "node_type")


@query
def binary_grid(spark, d):
    """Without the floor filter."""
    return classify.binary_grid(classify.classify(scene(spark, d).density, 500.0)).select("vid", "non_navigable")


@query
def class_counts(spark, d):
    return classify.class_counts(scene(spark, d).voxels)


@query
def class_counts_dilated(spark, d):
    return classify.class_counts(scene(spark, d, "dilated").voxels)


@query
def class_counts_adaptive(spark, d):
    return classify.class_counts(scene(spark, d, "adaptive").voxels)


@query
def uncertainty_grid(spark, d):
    return classify.uncertainty(scene(spark, d).around).select("vid", *_q("uncertainty"))


@query
def obstacle_ratio(spark, d):
    return classify.obstacle_ratio(scene(spark, d).around).select("vid", *_q("obs_ratio"))


def _features(name: str, *cols: str) -> None:
    def run(spark, d):
        return scene(spark, d).nodes.select("vid", "plan_idx", *_q(*cols))

    run.__name__ = f"feat_{name}"
    query(run)


FEATURES = {
    "position": ("f0", "f1", "f2"), "curvature": ("f3", "f4", "f5"), "density": ("f6",), "sigma": ("f7",), "alpha": ("f8",), "confidence": ("f9",),
    "info_gain": ("f10",), "frontier": ("f11",), "color": ("f12",), "free_ratio": ("f13",), "neighbor_occupied": ("f14",), "obstacle_distance": ("f15",),
}
for _name, _cols in FEATURES.items():
    _features(_name, *_cols)


@query
def node_features(spark, d):
    return scene(spark, d).nodes.select("vid", "plan_idx", "local_id", "uid", "node_type", *_q(*[f"f{k}" for k in range(16)]))


@query
def neutral_features(spark, d):
    return features.without_uncertainty(scene(spark, d).nodes).select("plan_idx", *_q("f9", "f10", "f11"))


@query
def type_local_ids(spark, d):
    return scene(spark, d).nodes.select("plan_idx", "node_type", "local_id", "uid")


@query
def legacy_view(spark, d):
    return edges.legacy_view(scene(spark, d).nodes).select("plan_idx", *_q("f0", "f1", "f2", "f6"))


@query
def offset_table(spark, d):
    rows = edges.stencil(scene(spark, d).grid)
    return spark.createDataFrame([(i, j, k, w) for i, j, k, w in rows], "di long, dj long, dk long, d double").select("di", "dj", "dk", *_q("d"))


def _stencil(name: str, a: int, b: int) -> None:
    def run(spark, d):
        return scene(spark, d).stencil.where((F.col("s_type") == a) & (F.col("t_type") == b)).select(F.col("s_idx").alias("src"), F.col("t_idx").alias("dst"), *_q("w"))

    run.__name__ = f"edges_{name}"
    query(run)


for _name, _a, _b in (("free_free", 0, 0), ("free_frontier", 0, 1), ("frontier_frontier", 1, 1)):
    _stencil(_name, _a, _b)


@query
def edges_knn(spark, d):
    s = scene(spark, d)
    return edges.knn_edges(s.nodes, s.grid).select(F.col("s_idx").alias("src"), F.col("t_idx").alias("dst"), F.col("rank").cast("long").alias("rank"), *_q("w"))


@query
def hetero_edges(spark, d):
    return scene(spark, d).hetero.select("src_type", "rel", "dst_type", "src", "dst", *_q("w"))


@query
def unified_edges(spark, d):
    return scene(spark, d).unified.select("src", "dst", *_q("w"))


@query
def adjacency(spark, d):
    s = scene(spark, d)
    return edges.adjacency(s.unified, s.nodes).select("src", "dst", *_q("w", "len", "dz"))


@query
def graph_stats(spark, d):
    s = scene(spark, d)
    return edges.graph_stats(s.nodes, s.hetero)


HASH_CELL = 0.3


def _hash(s):
    g = s.gaussians
    origin = hashgrid.origin_of(g)
    points = g.select(F.col("gid").alias("pid"), *[(F.col(k) + 0.02).alias(k) for k in "xyz"])
    return g, points, hashgrid.build(g, HASH_CELL, origin), origin


@query
def hash_build(spark, d):
    return _hash(scene(spark, d))[2]


@on_scene
def hash_candidates(s):
    g, points, _, origin = _hash(s)
    return hashgrid.candidates(g, points, HASH_CELL, origin, 0.05)


@on_scene
def hash_knn(s):
    g, points, _, origin = _hash(s)
    return hashgrid.nearest(g, points, HASH_CELL, origin, 0.05, 5).select("pid", F.col("rank").cast("long").alias("rank"), "gid", *_q("d"))


@query
def hash_stats(spark, d):
    return hashgrid.stats(_hash(scene(spark, d))[2])


@query
def snap_nodes(spark, d):
    s = scene(spark, d)
    return paths.snap(s.points, s.nodes, s.grid).select("pid", "uid", *_q("d"), paths.snap_status(F.col("d")).alias("status"))


@query
def batch_snap_anchors(spark, d):
    s = scene(spark, d)
    return paths.snap(s.points, s.nodes, s.grid).where(F.col("d") <= paths.MAX_SNAP).select("uid").distinct()


@query
def cost_scale(spark, d):
    s = scene(spark, d)
    return paths.cost_scale(s.hetero, s.grid.voxel_size).select(*_q("scale"))


def _heuristic(name: str, **how) -> None:
    def run(spark, d):
        s = scene(spark, d)
        return paths.heuristic(s.nodes, s.queries, paths.cost_scale(s.hetero, s.grid.voxel_size), **how).select("qid", "uid", *_q("h"))

    run.__name__ = name
    query(run)


_heuristic("heuristic_unc")
_heuristic("heuristic_geo", uncertain=False)
_heuristic("heuristic_line", line_bias=0.7)


@query
def edge_obstacle_penalty(spark, d):
    s = scene(spark, d)
    return paths.obstacle_penalty(s.unified, s.nodes, s.voxels, s.grid).select("src", "dst", *_q("penalty"))


@query
def segment_clear(spark, d):
    s = scene(spark, d)
    return paths.segment_clear(s.unified, s.nodes, s.voxels, s.grid)


def _goals(s) -> DataFrame:
    """Of all queries."""
    return paths.snap(s.points, s.nodes, s.grid).where("pid % 2 = 1").select(F.col("uid").alias("goal")).distinct()


@on_scene
def shortest_costs(s):
    return paths.shortest_costs(s.unified, _goals(s)).select("goal", "node", *_q("cost"))


@query
def goal_cost_cache(spark, d):
    """Goals of all queries that aren't in a cache of the first three's."""
    s = scene(spark, d)
    cache = paths.snap(s.points, s.nodes, s.grid).where("pid % 2 = 1 and pid < 6").select(F.col("uid").alias("goal"))
    return paths.missing_goals(_goals(s), cache)


# Paths: all of the scene's own points in turn, 24 a path

PATH_POINTS = 24


def _paths(s) -> DataFrame:
    qid = F.expr(f"gid div {PATH_POINTS}")  # of whole numbers, as the SQL's: a double would merge paths of ids beyond 2**53
    seq = (F.row_number().over(W.partitionBy("qid").orderBy("gid")) - 1).cast("int")  # PATH_POINTS rows a partition
    g = s.gaussians.withColumn("qid", qid).withColumn("seq", seq)
    return g.select("qid", "seq", "x", "y", "z", F.col("opacity").alias("f9"), (F.col("seq") % 2).alias("node_type"))


def _walls(s) -> DataFrame:
    return s.voxels.where("node_type = -1").select("x", "y", "z")


def _xyz(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("seq").cast("long").alias("seq"), *_q("x", "y", "z"))


@on_scene
def path_profile(s):
    return paths.path_profile(_paths(s)).where("slope is not null").select("qid", F.col("seq").cast("long").alias("seq"), *_q("slope", "curvature"))


@on_scene
def path_sections(s):
    return corridor.sections(_paths(s)).select("qid", F.col("seq").cast("long").alias("seq"), F.col("section").cast("long").alias("section"))


@on_scene
def corridor_width(s):
    return corridor.section_widths(corridor.sections(_paths(s))).select("qid", F.col("section").cast("long").alias("section"), *_q("width"))


def _tubes(s) -> DataFrame:
    rows = corridor.sections(_paths(s))
    return corridor.tubes(rows, corridor.section_widths(rows), s.grid.voxel_size)


@on_scene
def corridor_tubes(s):
    return _tubes(s).select("qid", F.col("section").cast("long").alias("section"), *_q("d0", "d1", "d2", "lo_d", "hi_d", "lo_u", "hi_u", "lo_v", "hi_v"))


def _faces(corridors: DataFrame) -> DataFrame:
    """One row for each row of A and b."""
    rows = corridors.select("qid", F.col("section").cast("long").alias("section"), "b", F.posexplode("a").alias("face", "row"))
    return rows.select("qid", "section", F.col("face").cast("long").alias("face"), *[q(F.get("row", n)).alias(f"a{n}") for n in range(3)], q(F.get("b", F.col("face"))).alias("b"))


@query
def corridor_half_spaces(spark, d):
    return _faces(corridor.half_spaces(_tubes(scene(spark, d))))


@query
def corridor_shrink(spark, d):
    return _faces(corridor.shrink(corridor.half_spaces(_tubes(scene(spark, d)))))


@on_scene
def segment_clearance(s):
    return trajectory.clearance(_paths(s), _walls(s)).select("qid", F.col("seq").cast("long").alias("seq"), *_q("clearance"))


@on_scene
def trajectory_collision(s):
    return trajectory.collides(_paths(s), _walls(s), s.grid.robot_radius)


@on_scene
def smooth_sweep(s):
    p = _paths(s)
    return _xyz(trajectory.smooth_sweep(p.select("qid", "seq", "x", "y", "z"), p))


@on_scene
def resample_polyline(s):
    return _xyz(trajectory.resample_arc(_paths(s), 0.05))


@on_scene
def trajectory_metrics(s):
    return trajectory.metrics(_paths(s), _walls(s)).select("qid", "n_points", *_q("path_length", "min_collision_dist", "smoothness"))


@on_scene
def trial_summary(s):
    trials = trajectory.metrics(_paths(s), _walls(s)).select(F.lit("own").alias("planner"), F.lit(True).alias("success"), "path_length", "min_collision_dist", "smoothness")
    return trajectory.trial_summary(trials).select("planner", "n", *_q("success_rate", "mean_path_length", "std_path_length", "mean_min_collision_dist", "mean_smoothness"))


def _ends(s, points: DataFrame) -> DataFrame:
    """Paths take the scene's queries in turn."""
    turn = (F.col("path") % len(QUERIES)).alias("qid")
    return points.select(F.col("qid").alias("path")).distinct().select("path", turn).join(s.queries, "qid").drop("qid").withColumnRenamed("path", "qid")


@on_scene
def force_endpoints(s):
    points = _paths(s)
    return _xyz(trajectory.force_ends(points, _ends(s, points)))


@on_scene
def fallback_smooth(s):
    points = _paths(s)
    return _xyz(trajectory.fallback_smooth(points, _ends(s, points), 0.05))


@on_scene
def finite_points(s):
    """Of all Gaussians, with some coordinates made NaN, infinite and null."""
    turn = F.col("gid") % 7
    x = F.when(turn == 0, float("nan")).when(turn == 1, float("-inf")).when(turn == 2, F.lit(None).cast("double")).otherwise(F.col("x"))
    return trajectory.finite(s.gaussians.select("gid", x.alias("x"), "y", "z")).select("gid", *_q("x", "y", "z"))


def _found(s) -> DataFrame:
    snaps = paths.snap(s.points, s.nodes, s.grid)
    return search.astar(s.queries, snaps, s.nodes, s.adjacency, paths.cost_scale(s.hetero, s.grid.voxel_size))


@query
def astar_results(spark, d):
    return _found(scene(spark, d))


@query
def astar_learned(spark, d):
    """The search with the network's estimates instead of the hand-made ones."""
    s = scene(spark, d)
    w = network.new_weights()
    scale = paths.cost_scale(s.hetero, s.grid.voxel_size)
    learned = network.decode(network.encode(s.nodes, s.unified, w), s.nodes, s.queries, w, scale.first()[0])
    return search.astar(s.queries, paths.snap(s.points, s.nodes, s.grid), s.nodes, s.adjacency, scale, learned=learned)


@query
def astar_paths(spark, d):
    s = scene(spark, d)
    return search.path_points(_found(s), s.nodes)


@query
def optimised_trajectory(spark, d):
    s = scene(spark, d)
    found = search.path_points(_found(s), s.nodes)
    return trajectory.optimise(found, s.nodes.where("node_type = 0"), _walls(s), s.grid.robot_radius)


# Network and training


@query
def segment_softmax(spark, d):
    s = scene(spark, d)
    return network.segment_softmax(s.unified.withColumn("score", 5 * F.col("w"))).select("src", "dst", *_q("alpha"))


@query
def attention_encode(spark, d):
    s = scene(spark, d)
    return network.encode(s.nodes, s.unified, network.new_weights())


@query
def attention_decode(spark, d):
    s = scene(spark, d)
    h = network.encode(s.nodes, s.unified, network.new_weights())
    return network.decode(h, s.nodes, s.queries, network.new_weights(), 10.0)


@on_scene
def feature_distance(s):
    return network.feature_distance(s.nodes, s.queries, 10.0).select("qid", "uid", *_q("h"))


@query
def train_tensors(spark, d):
    s = scene(spark, d)
    x, _ = learning.training_tensors(s.nodes, s.unified)
    rows = x.select("uid", "x", "y", "z", F.posexplode("features").alias("k", "value"))
    return rows.select("uid", F.col("k").cast("long").alias("k"), *_q("x", "y", "z", "value"))


TRAIN_EPOCHS, TRAIN_BUDGET = 2, 700


@query
def train_network(spark, d):
    """Loss of each epoch over the scene's queries whose start and goal are near a node."""
    s = scene(spark, d)
    near = paths.snap(s.points, s.nodes, s.grid).where(F.col("d") <= paths.MAX_SNAP).select("pid", "uid")
    start, goal = (near.where(F.col("pid") % 2 == k).select(F.floor(F.col("pid") / 2).alias("qid"), F.col("uid").alias(n)) for k, n in ((0, "start"), (1, "goal")))
    ends = start.join(goal, "qid").join(s.queries, "qid").select("goal", "start", "g_x", "g_y", "g_z")
    rows = written(learning.labels(s.unified, s.nodes, ends.select("goal").distinct(), TRAIN_BUDGET), "train-labels")
    state = learning.state_table(spark, learning.new_state(network.new_weights()))
    scale = paths.cost_scale(s.hetero, s.grid.voxel_size).first()[0]
    return learning.epoch_losses(learning.train(rows, ends, s.nodes, s.unified, state, scale, TRAIN_EPOCHS))


@query
def load_weights(spark, d):
    own = network.weight_table(spark, network.new_weights())
    saved = own.where("name not like 'unc%'").withColumn("shape", F.when(F.col("name") == "type", F.array(F.lit(3), F.lit(64))).otherwise(F.col("shape")))
    return network.load_weights(saved, own).select("name", "status")


@query
def random_pairs(spark, d):
    return training.random_pairs(1000, 100, spark)


def _costs(s) -> DataFrame:
    """Made-up costs of the goals of all queries, so that SQL can make the same ones."""
    goals = s.nodes.join(_goals(s).withColumnRenamed("goal", "uid"), "uid")
    goals = goals.select(F.col("uid").alias("goal"), *[F.col(k).alias(f"g_{k}") for k in "xyz"])
    far = F.sqrt(sum((F.col(k) - F.col(f"g_{k}")) ** 2 for k in "xyz"))
    return s.nodes.join(F.broadcast(goals), on=F.lit(True)).select("goal", F.col("uid").alias("node"), (3 * far + F.col("f6")).alias("cost"), (2 * far).alias("geo"), (2.7 * far + 0.1 * F.col("f13")).alias("pred"))


def _rows(s) -> DataFrame:
    return training.composite_target(_costs(s), s.nodes)


@on_scene
def train_samples(s):
    return training.samples(_costs(s), 700).select("goal", "node", *_q("cost"))


@on_scene
def composite_target(s):
    return _rows(s).select("goal", "node", *_q("target"))


@on_scene
def pointwise_loss(s):
    return training.pointwise(_rows(s)).select("goal", *_q("mse", "over"))


@on_scene
def ranking_loss(s):
    return training.ranking(_rows(s)).select("goal", *_q("rank"))


@on_scene
def monotonic_loss(s):
    return training.monotonic(_rows(s), s.unified).select("goal", *_q("mono"))


@on_scene
def simple_loss(s):
    return training.simple_loss(_rows(s)).select(*_q("loss"))


@on_scene
def total_loss(s):
    rows = _rows(s)
    ends = rows.groupBy("goal").agg(F.max("pred").alias("start_h"), F.min("pred").alias("goal_h"))
    return training.total_loss(rows, s.unified, ends).select("goal", *_q("bias", "loss"))


@query
def random_queries(spark, d):
    g = scene(spark, d).grid
    return sources.random_queries(spark, g.lower, g.upper, 50)


@query
def baseline_queries(spark, d):
    g = scene(spark, d).grid
    return sources.baseline_queries(spark, g.lower, g.upper)


@query
def read_pairs(spark, d):
    text = '[{"start": [0, 1, 2], "goal": [3, 4, 5]}, [[1, 1, 1], [2, 2, 2]], 7, {"start": [1]}, "x"]'
    return sources.read_pairs(spark.createDataFrame([(text,)], "value string"))
