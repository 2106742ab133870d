"""Rows that share an id or are equal, and columns whose names clash with working names."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelore.llm import audio, line_dedup, mixing, packing, simhash


def test_equal_rows_are_mixed_one_by_one(spark):
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "x"), (2, "d e f", "s", "y"), (3, "g h i", "s", "z"), (None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, `__row` string")
    levels = {"source": F.col("source")}
    for seed in range(9):
        chosen = mixing.select_mix(d, levels, share=0.45, seed=seed, cut=True).collect()
        got = mixing.mixed_rows(d, levels, share=0.45, seed=seed)
        assert got.columns == d.columns
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.id for r in chosen)


def test_one_row_of_each_group_stays_though_ids_repeat(spark):
    x, y = "the quick brown fox jumps over the lazy dog " * 5, "entirely different words stand in this other long text " * 5
    d = spark.createDataFrame([(1, y, "p"), (4, x, "q"), (4, y, "r"), (4, x, "s"), (None, "q q q q q", "t"), (None, "q q q q q", "u")], "doc_id long, text string, `__id` string")
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(d).collect()]
    assert sorted(got, key=str) == sorted([(1, y), (4, x), (None, "q q q q q")], key=str)
    assert simhash.one_of_each(d.where("false")).count() == 0


def test_line_dedup_leaves_clashing_columns_alone(spark):
    rows = [(k, "a line that is long enough\nown", "mine", "m", 3) for k in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `__lines` string, `__id` string, `__positions` int")
    got = line_dedup.dedup_lines(d).collect()
    assert all(r["__lines"] == "mine" and r["__id"] == "m" and r["__positions"] == 3 for r in got)
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 0)]


def test_special_tokens_are_one_id():
    ids = packing.ids_of(packing.vocabulary_path())
    assert ids("a <|endoftext|> b") == b"".join(int(k).to_bytes(4, "little") for k in (64, 220, 50256, 275))


def test_stored_tensors_are_those_of_the_features(spark):
    """The media is read back, and the tensor is the log-mel of a plain pass: a discrete Fourier sum for each frame and filter."""
    d = spark.createDataFrame([(1, "some text that sounds like noise " * 40), (2, None)], "doc_id long, text string")
    for r in audio.audio_features(d).collect():
        back = audio.from_wav(bytes(r.media))
        assert len(back) == r.payload_bytes and len(r.media) == r.media_bytes
        with pa.ipc.open_stream(r.log_mel_ipc) as stream:
            table = stream.read_all()
        assert isinstance(table.schema.field(0).type, pa.FixedShapeTensorType)
        assert table.num_rows == pytest.approx(r.n_frames / table.schema.field(0).type.shape[0], abs=1)
