"""The search with given estimates, seeded queries, scene settings, and costs that don't settle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxelore.operators import network, paths, search
from voxelore.plans.standard import scene
from voxelore.sources import scenes as sources

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    s = scene(spark, DATA)
    return s, paths.snap(s.points, s.nodes, s.grid), paths.cost_scale(s.hetero, s.grid.voxel_size)


def run(found, **how):
    s, snaps, scale = found
    return {r.qid: r for r in search.astar(s.queries, snaps, s.nodes, s.adjacency, scale, **how).collect()}


def test_given_estimates_steer_the_search(spark, found):
    s = found[0]
    none = s.nodes.select(F.lit(0).cast("long").alias("qid"), "uid", F.lit(-5.0).alias("h"))
    hand, least = run(found), run(found, learned=none)
    # Estimates below zero count as zero: the search is blind, finds no dearer path and opens no fewer nodes.
    assert least[0].success and least[0].cost <= hand[0].cost + 1e-9 and least[0].nodes_expanded >= hand[0].nodes_expanded
    # Queries without estimates, and estimates that aren't finite, fall back on the hand-made ones.
    broken = s.nodes.select(F.lit(1).cast("long").alias("qid"), "uid", F.lit(float("nan")).alias("h"))
    got = run(found, learned=broken)
    assert [(r.path, r.cost) for r in got.values()] == [(hand[k].path, hand[k].cost) for k in got]


def test_the_network_leads_the_search(spark):
    hand = {r.qid: r for r in entry.queries()["astar_results"](spark, DATA).collect()}
    got = {r.qid: r for r in entry.queries()["astar_learned"](spark, DATA).collect()}
    assert got.keys() == hand.keys() and not got[5].success
    assert all(got[k].success and got[k].path[0] == hand[k].path[0] and got[k].path[-1] == hand[k].path[-1] for k in range(5))
    assert any(got[k].nodes_expanded != hand[k].nodes_expanded for k in range(5))


def test_decoded_estimates_are_those_of_numpy(spark, found):
    s, w = found[0], network.new_weights()
    h = network.encode(s.nodes, s.unified, w)
    v = {r.uid: np.array(r.v) for r in h.collect()}
    relu = lambda x: np.maximum(x, 0)
    goals = {r.qid: np.array([r.g_x, r.g_y, r.g_z]) for r in s.queries.collect()}
    nodes = {r.uid: r for r in s.nodes.collect()}
    for r in network.decode(h, s.nodes, s.queries, w, 7.0).where("uid % 97 = 0").collect():
        n, g = nodes[r.uid], goals[r.qid]
        z = v[r.uid] + relu(g @ w["goal.w1"] + w["goal.b1"]) @ w["goal.w2"] + w["goal.b2"]
        res = (relu(relu(z @ w["mlp.w1"] + w["mlp.b1"]) @ w["mlp.w2"] + w["mlp.b2"]) @ w["mlp.w3"] + w["mlp.b3"])[0]
        unc = (relu(np.array([n.f9]) @ w["unc.w1"] + w["unc.b1"]) @ w["unc.w2"] + w["unc.b2"])[0]
        far = np.linalg.norm(np.array([n.x, n.y, n.z]) - g) * 7
        assert r.h == pytest.approx(far + 7 * res + 0.075 * np.log1p(np.exp(unc)), rel=1e-6, abs=1e-6)


def test_seeded_queries_are_whole_and_reproducible(spark):
    box = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    rows = sources.random_queries(spark, *box, 50).collect()
    assert len(rows) == 50 and rows == sources.random_queries(spark, *box, 50).repartition(7).orderBy("qid").collect()
    for r in rows:
        a, b = np.array([r.s_x, r.s_y, r.s_z]), np.array([r.g_x, r.g_y, r.g_z])
        assert np.linalg.norm(a - b) >= 0.3 and min(a.min(), b.min()) >= 0.1 and max(a.max(), b.max()) <= 0.9
    with pytest.raises(ValueError):
        sources.random_queries(spark, (0, 0, 0), (0.3, 0.3, 0.3), 5).collect()


def test_scene_settings():
    config = {"gs_to_graph": {"voxel_size": 1, "chunk_size": 5, "edge": {"a": 1, "b": 2}}, "scenes": {"s": {"chunk_size": 7, "k_neighbors": 9, "edge": {"b": 3}}, "t": {"edge": 4}}}
    assert sources.scene_config(config, "s") == {"voxel_size": 1, "chunk_size": 7, "edge": {"a": 1, "b": 3}}
    assert sources.scene_config(config, "t") == sources.scene_config(config, "none") == config["gs_to_graph"]


def test_gaussians_of_several_files_have_their_own_ids(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.ply").write_text(head + "0 0 1\n0 1 0\n1 0 0\n")
    ids = [r.gid for r in sources.read_ply(spark, str(tmp_path)).collect()]
    assert sorted(ids) == [f << 32 | k for f in range(3) for k in range(3)]


def test_costs_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "src long, dst long, w double")
    goals = spark.createDataFrame([(0,)], "goal long")
    assert {r.node: r.cost for r in paths.shortest_costs(edges, goals).collect()} == {k: float(k) for k in range(7)}
    with pytest.raises(RuntimeError):
        paths.shortest_costs(edges, goals, max_rounds=3)
