"""The language model: its probabilities, its gradients, what it learns from, and its scores against a plain pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelore.llm import attention_lm as lm
from voxelore.llm import queries
from voxelore.llm.packing import ids_of, vocabulary_path

SCHEMA = "doc_id long, text string"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def loud(seed=0, kind=np.float64):
    rng = np.random.default_rng(seed)
    return {k: (v + rng.normal(0, 0.2, v.shape)).astype(kind) for k, v in lm.new_params().items()}


def plain(p, ids):
    """Log probability of each id, one at a time, with a softmax over all ids at once."""
    out, seen = [], [lm.END, lm.END, *ids]  # seen[k + 1] is read when ids[k] is predicted
    of_class = np.arange(lm.IDS) // lm.CLASS
    for k, target in enumerate(ids):
        lo = max(0, (k // lm.BLOCK - 1) * lm.BLOCK)
        e = np.array([p["E"][seen[j + 1]] + p["P"][seen[j]] for j in range(lo, k + 1)])
        kv = (e @ p["kv"]).reshape(len(e), 2, lm.DIM)
        place = np.arange(lo, k + 1) - (k // lm.BLOCK - 1) * lm.BLOCK
        s = kv[:, 0] @ (e[-1] @ p["q"]) * lm.DIM**-0.5 + p["R"][k % lm.BLOCK, place]
        weights = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        h = e[-1] + (weights @ kv[:, 1]) @ p["o"]
        g = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
        classes = np.exp(g @ p["c"] + p["bc"])
        inner = np.exp(p["t"] @ g + p["bt"])
        per_class = inner.reshape(-1, lm.CLASS).sum(axis=1)
        all_ids = classes[of_class] / classes.sum() * inner / per_class[of_class]
        assert all_ids.sum() == pytest.approx(1, abs=1e-6)
        out.append(np.log(all_ids[target]))
    return np.array(out)


def test_log_probs_are_those_of_a_plain_pass():
    p, rng = loud(), np.random.default_rng(1)
    texts = [rng.integers(0, lm.IDS, n) for n in (1, 31, 32, 33, 64, 65, 150)]
    x, before, first, y, places = lm.blocks_of(np.concatenate(texts), np.array([len(t) for t in texts]))
    got = lm.log_probs(p, x, before, first, y)[places]
    np.testing.assert_allclose(got, np.concatenate([plain(p, t) for t in texts]), atol=1e-6)


def test_batches_do_not_change_log_probs(monkeypatch):
    p, rng = loud(2), np.random.default_rng(3)
    texts = [rng.integers(0, lm.IDS, n) for n in (300, 5, 90, 700)]
    parts = lm.blocks_of(np.concatenate(texts), np.array([len(t) for t in texts]))[:4]
    want = lm.log_probs(p, *parts)
    monkeypatch.setattr(lm, "AT_ONCE", 3)
    np.testing.assert_allclose(lm.log_probs(p, *parts), want, atol=1e-9)


def test_all_subwords_of_the_vocabulary_sum_to_one():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 5, 50_256) * rng.integers(0, 1000, 50_256)
    v = lm.Vocabulary.of(counts)
    assert len(np.unique(v.model_ids)) == lm.IDS - 1  # every id but the end mark stands for some subword
    ids = np.concatenate([[7, 9, k] for k in range(lm.IDS)])
    x, before, first, y, places = lm.blocks_of(ids, np.full(lm.IDS, 3))
    last = np.exp(lm.log_probs(loud(5), x, before, first, y)[places].reshape(-1, 3)[:, 2])
    assert last.sum() == pytest.approx(1, abs=1e-9)
    assert last[lm.END] + (last[v.model_ids] * np.exp(v.left_open)).sum() == pytest.approx(1, abs=1e-9)


def test_gradients_are_those_of_differences():
    p, rng = loud(6), np.random.default_rng(7)
    sizes = np.array([40, 7, 1, 130])
    w, first = lm.windows(rng.integers(0, lm.IDS, int(sizes.sum())), sizes, lambda text, block: block >= 0)
    _, n, d = lm._gradients(p, w, first)
    assert n == sizes.sum()
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(d[k])), d[k].shape)
        losses = []
        for step in (1e-5, -1e-5):
            other = {a: b.copy() for a, b in p.items()}
            other[k][at] += step
            losses.append(lm._gradients(other, w, first)[0])
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(d[k][at], rel=1e-3, abs=1e-4), k


def test_windows_show_the_model_what_scoring_shows():
    p, rng = loud(8), np.random.default_rng(9)
    sizes = np.array([5, 200, 64, 97])
    flat = rng.integers(0, lm.IDS, int(sizes.sum()))
    w, first = lm.windows(flat, sizes, lambda text, block: block >= 0)
    x, before, blocks_first, y, _ = lm.blocks_of(flat, sizes)
    assert lm._gradients(p, w, first)[0] == pytest.approx(-lm.log_probs(p, x, before, blocks_first, y).sum(), rel=1e-6)


def test_every_training_text_is_learned_from(spark, monkeypatch):
    """Over the shifts, every block of texts of any length is predicted once; with STRIDE = 1 a task predicts every id."""
    sizes = np.array([1, 20, 700, 3000, 64, 63])
    flat = np.concatenate([np.arange(n) % 4000 + 2 for n in sizes])
    targets = 0
    for shift in range(lm.STRIDE):
        w, _ = lm.windows(flat, sizes, lambda text, block: (block + shift) % lm.STRIDE == 0)  # noqa: B023
        targets += (w[:, 2 + lm.BLOCK :] != lm.PAD).sum()
    assert targets == sizes.sum()
    seen = []
    monkeypatch.setattr(lm, "STRIDE", 1)
    monkeypatch.setattr(lm, "_gradients", lambda p, w, first, own=lm._gradients: (seen.append(int((w[:, 2 + lm.BLOCK :] != lm.PAD).sum())), own(p, w, first))[1])
    raw = [np.arange(n).astype("<u2").tobytes() for n in sizes]

    class Shared:
        value = lm.new_params()

    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(raw, pa.binary())], ["row", "ids"])
    (found,) = lm._refine(Shared)(iter([rows]))
    assert sum(seen) == sizes.sum() == found.column(2)[0].as_py()


def test_words_beyond_the_first_thousand_have_identities():
    v = lm.Vocabulary.of(np.maximum(10_000 - np.arange(50_257), 0))
    assert len(set(v.model_ids[:4000].tolist())) == 4000 and lm.RARE not in v.model_ids[:4000] and not v.left_open[:4000].any()


def test_attention_reaches_thirty_two_ids_back():
    p, rng = loud(10), np.random.default_rng(2)
    ids = rng.integers(2, lm.IDS, 200)
    for at in (63, 64, 95, 130, 199):
        other = ids.copy()
        other[at - 32] = (ids[at - 32] + 1 - 2) % (lm.IDS - 2) + 2
        a, b = (lm.log_probs(p, *lm.blocks_of(s, np.array([200]))[:4])[at] for s in (ids, other))
        assert a != b


def test_scores_are_the_plain_pass_over_the_subwords(spark, monkeypatch):
    p = loud(11, np.float32)
    monkeypatch.setattr(lm, "train", lambda numbered, counts: p)
    vocabulary, own = [], lm.Vocabulary.of
    monkeypatch.setattr(lm.Vocabulary, "of", lambda counts: vocabulary.append(own(counts)) or vocabulary[-1])
    texts = ["The Lamp the lamp", None, "", "Ünïcode \U0001f600 x\ty " * 12, "the " * 70]
    got = {r.doc_id: r.score for r in lm.lm_scores(table(spark, texts)).collect()}
    encode = ids_of(vocabulary_path()).encode
    for k, text in enumerate(texts):
        subwords = [t for w in (text or "").encode().lower().split() for t in encode(" " + w.decode())]
        want = plain(p, [*vocabulary[0].model_ids[subwords], lm.END] if subwords else [lm.END]).sum() + (vocabulary[0].left_open[subwords].sum() if subwords else 0)
        assert got[k] == pytest.approx(want / lm.LN10, rel=1e-4)


def test_scores_do_not_depend_on_which_words_are_sent(spark, monkeypatch):
    d = table(spark, [" ".join(f"w{(k * j) % 97}" for j in range(40)) + f" own{k}" for k in range(120)] + [None, ""])
    want = sorted((r.doc_id, r.n_known, r.score, r.base_score) for r in lm.lm_scores(d).collect())
    monkeypatch.setattr(lm, "HOT_WORDS", 5)
    got = sorted((r.doc_id, r.n_known, r.score, r.base_score) for r in lm.lm_scores(d).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-4)


def test_hot_words_fit_their_bound(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{k}".encode(), 1 + k // 3) for k in range(30)], "word binary, c long")
    for bound, want in ((0, 0), (2, 0), (3, 3), (8, 6), (100, 27)):
        monkeypatch.setattr(lm, "HOT_WORDS", bound)
        assert lm.hot_words(counts).count() == want


def test_no_rows_no_training_rows_and_clashing_columns(spark):
    assert lm.lm_scores(table(spark, ["a"]).where("false")).collect() == []
    held = next(k for k in range(100) if not lm._training(k))
    (r,) = lm.lm_scores(spark.createDataFrame([(held, "a b")], SCHEMA)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score < 0
    rows = [(k, f"a b{k % 3}", 1, b"x", 2) for k in range(20)]
    odd = spark.createDataFrame(rows, SCHEMA + ", row int, ids binary, score int")
    want = {r.doc_id: r.score for r in lm.lm_scores(odd.select("doc_id", "text")).collect()}
    assert {r.doc_id: r.score for r in lm.lm_scores(odd).collect()} == pytest.approx(want, rel=1e-4)


def test_attention_alone_beats_the_base_on_held_out_texts(spark):
    rows = queries.op7_attention_lm(spark, "/root/testdata/sf0.01").where("held_out")
    n, base, score = rows.agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert -score / n < -base / n - 0.03
