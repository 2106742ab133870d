"""The entry module, and some queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["class_counts", "node_features", "edges_knn", "hetero_edges", "snap_nodes", "corridor_tubes", "resample_polyline", "shortest_costs", "corridor_half_spaces", "corridor_shrink", "segment_clearance", "trajectory_metrics", "smooth_sweep", "train_samples", "monotonic_loss", "total_loss", "density_at_points", "hash_knn", "goal_cost_cache", "fallback_smooth", "finite_points", "feature_distance", "train_tensors"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, found.fetchall()))


def test_astar_succeeds_and_fails_as_listed(spark):
    rows = {r.qid: r for r in entry.queries()["astar_results"](spark, DATA).collect()}
    assert rows[5].reason == "snap too far" and not rows[5].success
    assert all(rows[k].success and rows[k].path for k in range(5))
