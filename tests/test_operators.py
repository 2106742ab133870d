"""Operators against brute force on small fixtures."""

import math

import numpy as np
import pytest

from voxelore.functions.columns import numbered
from voxelore.operators import classify, corridor, density, edges, network, paths, trajectory
from voxelore.operators.scene import Grid, centers, make_grid

GRID = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (10, 10, 10), 0.1)
GAUSS = "gid long, x double, y double, z double, xx double, xy double, xz double, yy double, yz double, zz double, opacity double, luminance double"


def gaussians(spark, rows):
    return spark.createDataFrame(rows, GAUSS)


def test_one_isotropic_gaussian_is_symmetric_and_cut(spark):
    s = 0.1
    g = gaussians(spark, [(1, 0.5, 0.5, 0.5, s * s, 0.0, 0.0, s * s, 0.0, s * s, 0.8, 0.5)])
    rows = density.density_field(g, GRID).collect()
    w = 0.8 / math.sqrt((2 * math.pi) ** 3 * s**6)
    for r in rows:
        d2 = ((r.x - 0.5) ** 2 + (r.y - 0.5) ** 2 + (r.z - 0.5) ** 2) / s**2
        assert r.rho == pytest.approx(w * math.exp(-d2 / 2) if d2 < 9 else 0.0, rel=1e-9)
    assert len(rows) == 1000


def test_full_covariance_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows, mats = [], []
    for k in range(5):
        a = rng.normal(0, 0.1, (3, 3))
        c = a @ a.T + 0.003 * np.eye(3)
        m = rng.uniform(0, 1, 3)
        mats.append((m, c))
        rows.append((k, *map(float, m), *map(float, (c[0, 0], c[0, 1], c[0, 2], c[1, 1], c[1, 2], c[2, 2])), 0.5, 0.5))
    g = gaussians(spark, rows)
    got = {r.vid: r.rho for r in density.density_field(g, GRID).collect()}
    at = {r.vid: np.array([r.x, r.y, r.z]) for r in centers(spark, GRID).collect()}
    points = spark.createDataFrame([(v, *map(float, p)) for v, p in list(at.items())[::37]], "pid long, x double, y double, z double")
    near = {r.pid: r.rho for r in density.at_points(g, points).collect()}
    for v, p in at.items():
        want = 0.0
        for m, c in mats:
            d2 = (p - m) @ np.linalg.inv(c) @ (p - m)
            want += 0.5 / math.sqrt((2 * math.pi) ** 3 * np.linalg.det(c)) * math.exp(-d2 / 2) if d2 < 9 else 0
        assert got[v] == pytest.approx(min(want, 1e6), rel=1e-6, abs=1e-9)
        if v in near:
            assert near[v] == pytest.approx(got[v], rel=1e-6, abs=1e-9)


def test_empty_scene_is_free_but_for_the_floor(spark):
    g = gaussians(spark, [])
    with pytest.raises(ValueError):
        make_grid(g)
    vox = classify.floor_filter(classify.classify(density.density_field(g, GRID), 0.5), GRID)
    assert {r.node_type: r.n for r in classify.class_counts(vox).collect()} == {0: 900, -1: 100}


def test_box_sums_and_dilation_against_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.random((6, 5, 4)) < 0.1
    rows = [(int(i), int(j), int(k), -1 if a[i, j, k] else 0, float(i + j * k)) for i, j, k in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, "ix long, iy long, iz long, node_type int, rho double")
    for steps in (1, 2):
        pad = np.pad(a, steps)
        want = np.zeros_like(a)
        for i, j, k in np.ndindex(a.shape):
            want[i, j, k] = pad[i : i + 2 * steps + 1, j : j + 2 * steps + 1, k : k + 2 * steps + 1].any()
        got = {(r.ix, r.iy, r.iz): r.node_type == -1 for r in classify.dilate(df, steps).collect()}
        assert all(got[i] == want[i] for i in np.ndindex(a.shape))
    around = {(r.ix, r.iy, r.iz): r for r in classify.neighbourhood(df).collect()}
    assert around[0, 0, 0].n27 == 8 and around[2, 2, 2].n27 == 27


def test_nan_and_negative_density_are_unknown(spark):
    df = spark.createDataFrame([(float("nan"),), (-1.0,), (None,), (0.0,), (0.3,), (9.0,)], "rho double")
    assert sorted(r.node_type for r in classify.classify(df, 1.0, adaptive=False).collect()) == [-1, 0, 1, 2, 2, 2]


def test_numbered_is_the_rank(spark):
    df = spark.createDataFrame([(k * 7 % 101 * 1000, k % 2) for k in range(101)], "v long, g int")
    rows = numbered(numbered(df, "v", "n", block=5000), "v", "m", ["g"], block=7000).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.v)] == list(range(101))
    for g in (0, 1):
        assert [r.m for r in sorted((r for r in rows if r.g == g), key=lambda r: r.v)] == list(range(sum(r.g == g for r in rows)))


def test_shortest_costs_on_an_asymmetric_graph(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 0, 0.5), (3, 4, 1.0)], "src long, dst long, w double")
    goals = spark.createDataFrame([(0,)], "goal long")
    assert {r.node: r.cost for r in paths.shortest_costs(e, goals).collect()} == {0: 0.0, 1: 1.0, 2: 2.0}
    assert {r.node: r.cost for r in paths.shortest_costs(e, goals, reverse=True).collect()} == {0: 0.0, 2: 0.5, 1: 1.5}


def test_sections_share_ends_and_the_last_takes_the_tail(spark):
    p = spark.createDataFrame([(1, k) for k in range(40)] + [(2, 0)], "qid long, seq int")
    got = {}
    for r in corridor.sections(p).collect():
        got.setdefault((r.qid, r.section), []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {**{(1, s): list(range(5 * s, 5 * s + 6)) for s in range(5)}, (1, 5): list(range(25, 40))}


def test_corridor_holds_its_points(spark):
    rng = np.random.default_rng(4)
    rows = [(1, k, *map(float, rng.random(3)), 0, 0.5) for k in range(12)]
    p = corridor.sections(spark.createDataFrame(rows, "qid long, seq int, x double, y double, z double, node_type int, f9 double"))
    spaces = {r.section: r for r in corridor.half_spaces(corridor.tubes(p, corridor.section_widths(p), 0.1)).collect()}
    for r in p.collect():
        assert (np.array(spaces[r.section].a) @ [r.x, r.y, r.z] <= np.array(spaces[r.section].b) + 1e-9).all()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9])
def test_pchip_keeps_ends_and_passes_the_points(n):
    p = np.random.default_rng(n).random((n, 3))
    out = trajectory.pchip(p, 50)
    assert len(out) == (50 if n else 0)
    if n:
        assert np.allclose(out[0], p[0]) and np.allclose(out[-1], p[-1])
    flat = trajectory.pchip(np.repeat([[1.0, 2.0, 3.0]], 4, axis=0), 10)
    assert np.allclose(flat, [1, 2, 3])


def test_repair_leads_around_an_obstacle():
    p, walls = np.array([[0.0, 0, 0], [1.0, 0, 0]]), np.array([[0.5, 0, 0]])
    free = np.array([[0.5, 0.1, 0], [0.5, 0.3, 0], [3.0, 3, 3]])
    out = trajectory.repair(p, free, walls, 0.05)
    assert np.allclose(out[1], [0.5, 0.1, 0])


def test_segment_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, -500.0), (2, 500.0)], "dst long, score double")
    sums = {r.dst: r.s for r in network.segment_softmax(df).groupBy("dst").agg({"alpha": "sum"}).withColumnRenamed("sum(alpha)", "s").collect()}
    assert sums[1] == pytest.approx(1, abs=1e-6) and sums[2] == pytest.approx(1, abs=1e-6)


def test_stencil_has_26_offsets():
    assert len(edges.stencil(GRID)) == 26
