"""The refinement of op7 as it stands, without any setting changed, learns from every id of every text."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("voxelore.llm.attention_lm")

from voxelore.llm import attention_lm as lm


def test_refinement_predicts_every_id_once(monkeypatch):
    sizes, seen = [1, 31, 32, 33, 257, 2000], np.zeros(lm.IDS, int)
    flat = np.arange(sum(sizes)) % 4000 + 2
    raw = [x.astype("<u2").tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]

    def gradients(p, w, first, own=lm._gradients):
        y = w[:, 2 + lm.BLOCK :]
        np.add.at(seen, y[y != lm.PAD], 1)
        return own(p, w, first)

    monkeypatch.setattr(lm, "_gradients", gradients)

    class Shared:
        value = lm.new_params()

    rows = pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(raw, pa.binary())], ["row", "ids"])
    (found,) = lm._refine(Shared)(iter([rows]))
    assert found.column(2)[0].as_py() == sum(sizes)
    assert (seen == np.bincount(flat, minlength=lm.IDS)).all()
