"""The state of the exact deduplication has as many partitions as its keys need, not as many as a shuffle of whole texts."""

import os
from collections import Counter

import pytest

from voxelore.llm import exact_dedup


@pytest.mark.parametrize(("state_rows", "partitions"), [(exact_dedup.STATE_ROWS if hasattr(exact_dedup, "STATE_ROWS") else 50_000, 1), (100, 3), (10, 4)])
def test_partitions_follow_the_rows(spark, monkeypatch, state_rows, partitions):
    used = []

    def remove(session, *paths, own=exact_dedup.remove):
        used.extend(len([x for x in os.listdir(f"{p.removeprefix('file:')}/state/0") if x.isdigit()]) for p in paths)
        own(session, *paths)

    monkeypatch.setattr(exact_dedup, "remove", remove)
    monkeypatch.setattr(exact_dedup, "STATE_ROWS", state_rows, raising=False)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", *exact_dedup.STATE_CONF)}
    rows = [(k, f"Text {k % 70}") for k in range(250)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = Counter(t for _, t in rows)
    last = {t: k for k, t in rows}
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == [(k, last[t], sizes[t], last[t] == k) for k, t in rows]
    assert used == [partitions]
    assert {k: spark.conf.get(k, None) for k in before} == before
