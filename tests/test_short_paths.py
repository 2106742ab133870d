"""Metrics of paths too short for a length or a smoothness, against the SQL."""

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("rows", [24 + 1, 24 + 2])
@pytest.mark.parametrize("name", ["trajectory_metrics", "trial_summary"])
def test_last_path_is_short(spark, tmp_path, name, rows):
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").sort_by("vec_id").slice(0, rows)
    pq.write_table(t, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    got = entry.queries()[name](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
