"""The spatial hash's pairs and nearest ones without a row for each shared cell, against the SQL on odd tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from voxelore.operators import hashgrid
from voxelore.plans.standard import scene


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Vectors four times under shifted keys, some keys twice, far ones, and one without a first number."""
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").sort_by("vec_id").slice(0, 120).to_pydict()
    rows = [(k + 500 * copy, v) for copy in range(4) for k, v in zip(t["vec_id"], t["embedding"], strict=True)]
    rows += [(k, [x + 0.01 for x in v]) for k, v in rows[:10]]
    rows += [(9000 + n, [3.0 * n, *rows[n][1][1:]]) for n in range(4)] + [(9900, [None, *rows[5][1][1:]])]
    d = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"vec_id": pa.array([k for k, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}), d / "embeddings.parquet")
    return str(d)


def against_sql(spark, d, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{d}/embeddings.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    got = entry.queries()[name](spark, d).select(*cols)
    rows = sorted(map(tuple, got.collect()))
    # The SQL's rank among rows of one key twice is open, so ranks are compared by distance.
    keep = [k for k, c in enumerate(cols) if c != "gid" or name == "hash_candidates"]
    cut = lambda x: sorted(tuple(r[k] for k in keep) for r in x)
    assert cut(rows) == cut(found.fetchall())
    return got


def test_candidates_are_made_once(spark, odd, monkeypatch):
    monkeypatch.setattr(hashgrid, "LISTED", 50, raising=False)
    monkeypatch.setattr(hashgrid, "PAIRS_A_TASK", 50_000, raising=False)
    got = against_sql(spark, odd, "hash_candidates")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # No step sees the pairs again after they are made: before, they were made once for each shared cell and then made distinct.
    assert "Aggregate [pid" not in plan.split("Generate explode(gids")[0]


def test_nearest_are_looked_for_nearby(spark, odd, monkeypatch):
    against_sql(spark, odd, "hash_knn")
    asked, whole = [], hashgrid.candidates
    monkeypatch.setattr(hashgrid, "candidates", lambda a, points, *more: (asked.append(points.count()), whole(a, points, *more))[1])
    against_sql(spark, "/root/testdata/sf0.1", "hash_knn")
    n = scene(spark, "/root/testdata/sf0.1").gaussians.count()
    assert asked and asked[0] < n / 4  # the others' neighbours come from nearby cells
