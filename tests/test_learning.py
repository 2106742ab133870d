"""Training of the heuristic network, checkpoints, and the operators around search and smoothing."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxelore.operators import learning, network, search, training, trajectory
from voxelore.plans import store
from voxelore.plans.standard import scene
from voxelore.sources import scenes as sources

DATA = "/root/testdata/sf0.001"
N, SCALE = 30, 2.0


@pytest.fixture(scope="module")
def small(spark):
    """A random connected graph with labels of two goals, as DataFrames."""
    rng = np.random.default_rng(3)
    x, xyz = rng.normal(0, 1, (N, 16)), rng.uniform(0, 1, (N, 3))
    pairs = {(k, (k + 1) % N) for k in range(N)} | {tuple(map(int, p)) for p in rng.integers(0, N, (60, 2)) if p[0] != p[1]}
    pairs |= {(b, a) for a, b in pairs}
    edges = spark.createDataFrame([(a, b, float(np.linalg.norm(xyz[a] - xyz[b]))) for a, b in sorted(pairs)], "src long, dst long, w double")
    cols = ", ".join(f"f{k} double" for k in range(16))
    nodes = spark.createDataFrame([(k, *map(float, xyz[k]), *map(float, x[k])) for k in range(N)], f"uid long, x double, y double, z double, {cols}")
    ends = spark.createDataFrame([(g, s, *map(float, xyz[g])) for g, s in ((4, 20), (11, 2))], "goal long, start long, g_x double, g_y double, g_z double")
    rows = learning.labels(edges, nodes, ends.select("goal"), 20).select("goal", "node", "target")
    return nodes, edges, ends, spark.createDataFrame(rows.collect(), rows.schema)


def weights(seed=1):
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(0, 0.05, v.shape) for k, v in network.new_weights(seed).items()}


def arrays(small):
    nodes, edges, ends, rows = small
    g = learning.TrainGraph.of(nodes.toPandas(), edges.toPandas())
    records = []
    for e in ends.orderBy("goal").collect():
        own = rows.where(F.col("goal") == e.goal).orderBy("node").toPandas()
        records.append({"goal": e.goal, "start": e.start, "xyz": np.array([e.g_x, e.g_y, e.g_z]), "hard": False, "node": own["node"].to_numpy(), "target": own["target"].to_numpy()})
    return g, records


def test_forward_and_loss_are_those_of_the_dataframes(spark, small):
    nodes, edges, ends, rows = small
    w, (g, records) = weights(), arrays(small)
    h, _ = learning.forward(w, g)
    v = network.encode(nodes, edges, w)
    assert np.allclose(h, [r.v for r in v.orderBy("uid").collect()], atol=1e-9)
    given = network.decode(v, nodes, ends.withColumn("qid", F.col("goal")), w, SCALE).withColumnRenamed("qid", "goal")
    given = spark.createDataFrame(given.collect(), given.schema)
    near = nodes.select("uid", "x", "y", "z").join(ends)
    geo = near.select("goal", "uid", (SCALE * F.sqrt(sum((F.col(k) - F.col(f"g_{k}")) ** 2 for k in "xyz"))).alias("geo"))
    both = rows.join(given.select("goal", F.col("uid").alias("node"), F.col("h").alias("pred")), ["goal", "node"]).join(geo.withColumnRenamed("uid", "node"), ["goal", "node"])
    at = lambda c, n: given.select(F.col("goal"), F.col("uid").alias(c), F.col("h").alias(n))
    sides = ends.select("goal", "start").join(at("start", "start_h"), ["goal", "start"]).join(at("uid", "goal_h").where("goal = uid"), "goal").select("goal", "start_h", "goal_h")
    wanted = {r.goal: r.loss for r in training.total_loss(both, edges, sides).collect()}
    for r in records:
        assert learning.gradients(w, g, r, SCALE)[0] == pytest.approx(wanted[r["goal"]], rel=1e-9)


def test_gradients_are_those_of_differences(small):
    w, (g, records) = weights(), arrays(small)
    _, d = learning.gradients(w, g, records[0], SCALE)
    assert d.keys() == w.keys() and all(d[k].shape == w[k].shape for k in w)
    rng = np.random.default_rng(0)
    for k in w:
        for at in rng.integers(0, w[k].size, 3):
            sides = []
            for by in (1e-6, -1e-6):
                moved = {n: v.copy() for n, v in w.items()}
                moved[k].flat[at] += by
                sides.append(learning.gradients(moved, g, records[0], SCALE)[0])
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(d[k].flat[at], rel=1e-3, abs=1e-6), k


def test_training_lowers_the_loss_and_resumes_from_a_checkpoint(spark, small, tmp_path):
    nodes, edges, ends, rows = small
    start = learning.state_table(spark, learning.new_state(network.new_weights()))
    go = lambda state, n: learning.train(rows, ends, nodes, edges, state, SCALE, n)
    whole = go(start, 12)
    losses = [r.loss for r in learning.epoch_losses(whole).orderBy("epoch").collect()]
    assert len(losses) == 12 and losses[-1] < 0.7 * losses[0]
    learning.save_checkpoint(go(start, 5), str(tmp_path))
    meta = spark.read.json(f"{tmp_path}/meta").first()
    assert meta.epoch == 5
    again = learning.state_arrays(go(learning.load_checkpoint(spark, str(tmp_path)), 7))
    other = learning.state_arrays(whole)
    assert again.keys() == other.keys() and all(np.array_equal(again[k], other[k]) for k in other)
    learning.state_table(spark, {k: v for k, v in other.items() if k != "in.b"}).write.mode("overwrite").parquet(f"{tmp_path}/state")
    with pytest.raises(ValueError):
        learning.load_checkpoint(spark, str(tmp_path))


def test_hard_ends_take_their_turn(small):
    g, records = arrays(small)
    one = learning.fit(learning.new_state(weights()), g, [records[0], records[1] | {"hard": True}], SCALE, 4, hard_repeat=2)
    assert one["steps"][0] == 4 + 2  # epochs 0 and 3
    empty = learning.fit(learning.new_state(weights()), g, [], SCALE, 3)
    assert len(empty["losses"]) == 0


def test_the_scene_trains(spark):
    rows = entry.queries()["train_network"](spark, DATA).orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [0, 1] and rows[1].loss < rows[0].loss


def test_finite_points(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (nan, 0.0, 0.0), (0.0, inf, 0.0), (0.0, 0.0, -inf), (None, 0.0, 0.0)], "x double, y double, z double")
    assert [tuple(r) for r in trajectory.finite(df).collect()] == [(0.0, 1.0, 2.0)]


def test_fallback_smoother(spark):
    queries = spark.createDataFrame([(q, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0) for q in range(4)], "qid long, s_x double, s_y double, s_z double, g_x double, g_y double, g_z double")
    paths = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (1, 3, 0.0, 1.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 0.5, 0.0, 0.0)]
    points = spark.createDataFrame(paths, "qid long, seq int, x double, y double, z double")
    got = {}
    for r in trajectory.fallback_smooth(points, queries, 0.25).orderBy("qid", "seq").collect():
        got.setdefault(r.qid, []).append((r.x, r.y, r.z))
    line = [(0.25 * k, 0.0, 0.0) for k in range(5)]
    assert all(np.allclose(got[k], line) for k in (0, 2, 3))  # ends there already, goal missing, no path at all
    assert got[1][0] == (0, 0, 0) and got[1][-1] == pytest.approx((1, 0, 0)) and len(got[1]) == 11  # 1 + sqrt(2) long, by way of (0, 1, 0)
    assert trajectory.fallback_smooth(points.limit(0), queries.limit(0)).count() == 0


def test_search_stops_at_its_time(spark):
    s = scene(spark, DATA)
    graph = search.Graph(s.nodes.toPandas(), s.adjacency.toPandas())
    a, b = graph.xyz[0], graph.xyz[-1]
    h = np.zeros(len(graph.xyz))
    assert search.search(graph, 0, len(h) - 1, a, b, h, search.Costs(max_seconds=0))[:3] == ([], 0, "time limit")
    assert search.search(graph, 0, len(h) - 1, a, b, h, search.Costs(max_seconds=3600))[2] != "time limit"


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder):
        nothing = SimpleNamespace(isDefined=lambda: False)
        jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing))
        context = SimpleNamespace(master=master, _jsc=jsc, getConf=lambda: {}, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)

    assert store.shared_dir(session("spark://a:7077", "hdfs://b/c/")) == "hdfs://b/c"
    with pytest.raises(RuntimeError):
        store.shared_dir(session("spark://a:7077", None))


def test_baseline_queries(spark):
    rows = sources.baseline_queries(spark, (0.0, 0.0, 0.0), (2.0, 1.0, 1.0)).collect()
    assert len(rows) == 50
    assert all(0.2 <= r[f"{p}_{k}"] <= (1.8 if k == "x" else 0.8) for r in rows for p in "sg" for k in "xyz")
