"""Metrics of paths whose ids are negative, beyond a double's whole numbers or missing, against the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.mark.parametrize("key", ["vec_id - 100", "vec_id + (1::bigint << 60)", "CASE WHEN vec_id % 7 > 0 THEN vec_id END"])
@pytest.mark.parametrize("name", ["trial_summary", "trajectory_metrics"])
def test_paths_of_any_ids(spark, tmp_path, name, key):
    con = duckdb.connect()
    con.execute(f"copy (select * replace ({key} as vec_id) from (select * from '{SOURCE}' order by vec_id limit 250)) to '{tmp_path}/embeddings.parquet' (format parquet)")
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    got = entry.queries()[name](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
