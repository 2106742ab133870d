"""Queries over the whole scene against brute force on the smallest tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from voxelore.plans.queries import PATH_POINTS, _costs, _goals
from voxelore.plans.standard import scene

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    t = pq.read_table(f"{DATA}/embeddings.parquet").to_pydict()
    e = np.array(t["embedding"], float)
    order = np.argsort(t["vec_id"])
    return np.array(t["vec_id"])[order], e[order]


def run(spark, name):
    return entry.queries()[name](spark, DATA)


def test_every_gaussian_is_a_probe_point(spark, own):
    gid, e = own
    at, s = e[:, :3], 0.02 + 0.1 * np.abs(e[:, 3:6])
    w = np.minimum(1e6, 1 / (1 + np.exp(-4 * e[:, 6])) / np.sqrt((2 * np.pi) ** 3 * np.maximum((s**2).prod(axis=1), 1e-12)))
    d2 = (((at + 0.01)[:, None] - at[None]) ** 2 / s[None] ** 2).sum(axis=2)
    rho = np.minimum(1e6, np.where(d2 < 9, w * np.exp(-d2 / 2), 0).sum(axis=1))
    got = {r.pid: r.rho for r in run(spark, "density_at_points").collect()}
    assert got.keys() == set(gid.tolist())
    np.testing.assert_allclose([got[k] / 1e6 for k in gid.tolist()], rho, rtol=1e-6, atol=1e-5)
    assert {r.pid for r in run(spark, "hash_candidates").collect()} == {r.pid for r in run(spark, "hash_knn").collect()} == set(gid.tolist())


def test_every_gaussian_is_on_a_path(spark, own):
    gid, e = own
    runs = {}
    for k, g in enumerate(gid.tolist()):
        runs.setdefault(g // PATH_POINTS, []).append(e[k, :3])
    got = run(spark, "trajectory_metrics").collect()
    assert sum(r.n_points for r in got) == len(gid)
    walls = np.array([[r.x, r.y, r.z] for r in scene(spark, DATA).voxels.where("node_type = -1").collect()])
    for r in got:
        p = np.array(runs[r.qid])
        assert r.n_points == len(p)
        assert r.path_length / 1e6 == pytest.approx(np.linalg.norm(np.diff(p, axis=0), axis=1).sum(), abs=2e-6)
        assert r.min_collision_dist / 1e6 == pytest.approx(np.linalg.norm(p[:, None] - walls[None], axis=2).min(), abs=2e-6)
    steps = sum(len(p) - 1 for p in runs.values())
    assert run(spark, "segment_clearance").count() == steps and run(spark, "smooth_sweep").count() == len(gid)
    long = {k for k, p in runs.items() if len(p) > 1}
    for name in ("path_sections", "corridor_width", "corridor_tubes", "corridor_half_spaces", "corridor_shrink"):
        assert {r.qid for r in run(spark, name).select("qid").distinct().collect()} == long
    assert {r.qid for r in run(spark, "force_endpoints").select("qid").distinct().collect()} == set(runs)


def test_every_query_has_its_goal(spark):
    s = scene(spark, DATA)
    goals = {r.goal for r in _goals(s).collect()}
    assert {r.goal for r in run(spark, "shortest_costs").select("goal").distinct().collect()} == goals
    rows = {}
    for r in _costs(s).collect():
        rows[r.goal, r.node] = r
    assert len(rows) == len(goals) * s.nodes.count()
    target = {(r.goal, r.node): r.target / 1e6 for r in run(spark, "composite_target").collect()}
    assert target.keys() == rows.keys()
    hinge = {g: [] for g in goals}
    scale = {g: max(1, np.mean([abs(t) for (a, _), t in target.items() if a == g])) for g in goals}
    edges = s.unified.collect()
    for g in goals:
        for r in edges:
            true = target[g, r.dst] - target[g, r.src]
            if abs(true) > 1e-4:
                hinge[g].append(max(0.02 * scale[g] - (rows[g, r.dst].pred - rows[g, r.src].pred) * np.sign(true), 0) / scale[g])
    got = {r.goal: r.mono / 1e6 for r in run(spark, "monotonic_loss").collect()}
    assert got == {g: pytest.approx(np.mean(h), abs=2e-4) for g, h in hinge.items()}
