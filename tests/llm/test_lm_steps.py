"""op7's steps: taken in parts that fit a cache, equal to the whole, and right beyond float32's range."""

import tracemalloc

import numpy as np
import pytest

pytest.importorskip("voxelore.llm.attention_lm")

from voxelore.llm import attention_lm as lm


def step(n, kind=np.float32):
    rng = np.random.default_rng(0)
    p = {k: (v + rng.normal(0, 0.2, v.shape)).astype(kind) for k, v in lm.new_params().items()}
    return p, *lm.windows(rng.integers(2, lm.IDS, n * lm.BLOCK - 5), np.array([n * lm.BLOCK - 5]), lambda text, block: block >= 0)


def test_a_step_holds_little_at_once():
    p, w, first = step(lm.STEP_WINDOWS)
    lm._gradients(p, w, first)
    tracemalloc.start()
    lm._gradients(p, w, first)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 25e6


def test_parts_of_a_step_sum_to_its_gradients(monkeypatch):
    p, w, first = step(100, np.float64)
    found = []
    for size in (1000, 7):
        monkeypatch.setattr(lm, "WINDOWS_AT_ONCE", size)
        found.append(lm._gradients(p, w, first))
    (loss, n, d), (other, m, e) = found
    assert n == m == 100 * lm.BLOCK - 5 and loss == pytest.approx(other)
    for k in p:
        np.testing.assert_allclose(e[k], d[k], rtol=1e-6, atol=1e-9, err_msg=k)


@pytest.mark.parametrize("scale", [1, 60, -60])
def test_outputs_beyond_the_range_of_float32(scale):
    """Loss and gradients in float32 as in float64, where exponentials of the outputs overflow or vanish."""
    p, w, first = step(20, np.float64)
    p["bt"] += scale * 3
    p["bc"] += scale * 3
    p["bt"][::7] += abs(scale) / 10
    loss, n, d = lm._gradients(p, w, first)
    low, m, e = lm._gradients({k: v.astype(np.float32) for k, v in p.items()}, w, first)
    assert n == m and low == pytest.approx(loss, rel=1e-4)
    for k in p:
        np.testing.assert_allclose(e[k], d[k], atol=2e-3 * np.abs(d[k]).max(), err_msg=k)
