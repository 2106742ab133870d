"""The graph-attention heuristic over DataFrames: projections node by node, attention by joins and grouped sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IN, HIDDEN, HEADS, LAYERS, EPS = 16, 64, 4, 2, 1e-9
OUT = HIDDEN // HEADS


def new_weights(seed: int = 42) -> dict[str, np.ndarray]:
    """Xavier-uniform matrices, zero biases."""
    rng = np.random.default_rng(seed)

    def xavier(*shape: int) -> np.ndarray:
        lim = (6 / (shape[0] + shape[-1])) ** 0.5
        return rng.uniform(-lim, lim, shape)

    w = {"in.w": xavier(IN, HIDDEN), "in.b": np.zeros(HIDDEN), "type": rng.normal(0, 1, (2, HIDDEN)), "goal.w1": xavier(3, HIDDEN), "goal.b1": np.zeros(HIDDEN), "goal.w2": xavier(HIDDEN, HIDDEN), "goal.b2": np.zeros(HIDDEN)}
    for k in range(LAYERS):
        w |= {f"{k}.lin": xavier(HIDDEN, HIDDEN), f"{k}.edge": xavier(1, HIDDEN), f"{k}.src": xavier(HEADS, OUT), f"{k}.dst": xavier(HEADS, OUT), f"{k}.att": xavier(HEADS, OUT)}
        w |= {f"{k}.bias": np.zeros(HIDDEN), f"{k}.gain": np.ones(HIDDEN), f"{k}.shift": np.zeros(HIDDEN)}
    for name, a, b in (("1", HIDDEN, HIDDEN), ("2", HIDDEN, HIDDEN // 2), ("3", HIDDEN // 2, 1)):
        w |= {f"mlp.w{name}": xavier(a, b), f"mlp.b{name}": np.zeros(b)}
    return w | {"unc.w1": xavier(1, 16), "unc.b1": np.zeros(16), "unc.w2": xavier(16, 1), "unc.b2": np.zeros(1)}


def weight_table(spark, w: dict[str, np.ndarray]) -> DataFrame:
    rows = [(k, [int(n) for n in v.shape], [float(x) for x in v.ravel()]) for k, v in sorted(w.items())]
    return spark.createDataFrame(rows, "name string, shape array<int>, data array<double>")


def load_weights(saved: DataFrame, own: DataFrame) -> DataFrame:
    """(name, status, data): loaded where name and shape agree, else skipped, missing or unknown."""
    a, b = saved.alias("a"), own.alias("b")
    both = b.join(a, F.col("a.name") == F.col("b.name"), "full")
    status = F.when(F.col("a.name").isNull(), "missing").when(F.col("b.name").isNull(), "unknown").when(F.col("a.shape") == F.col("b.shape"), "loaded").otherwise("skipped")
    return both.select(F.coalesce("b.name", "a.name").alias("name"), status.alias("status"), F.when(status == "loaded", F.col("a.data")).otherwise(F.col("b.data")).alias("data"))


def segment_softmax(scores: DataFrame, key: str = "dst", value: str = "score") -> DataFrame:
    """Adds alpha: exp of the score less its group's greatest, cut to +-60, over the group's sum."""
    by = W.partitionBy(key)
    e = F.exp(F.least(F.greatest(F.col(value) - F.max(value).over(by), F.lit(-60.0)), F.lit(60.0)))
    return scores.withColumn("e", e).withColumn("alpha", F.col("e") / (F.sum("e").over(by) + EPS)).drop("e")


def _map(rows: DataFrame, f, n: int) -> DataFrame:
    """(uid, v) from rows (uid, arrays...), a matrix function of each batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = f(*[np.stack(b[c].to_numpy()) if len(b) else np.zeros((0, n)) for c in b.columns[1:]])
            yield pd.DataFrame({"uid": b["uid"], "v": list(out)})

    return rows.mapInPandas(run, "uid long, v array<double>")


def project_in(nodes: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    """(uid, v): the input projection plus the embedding of the node's type, read from feature 11."""
    x = nodes.select("uid", F.array(*[f"f{k}" for k in range(IN)]).alias("x"))
    return _map(x, lambda x: x @ w["in.w"] + w["in.b"] + w["type"][(x[:, 11] > 0.5).astype(int)], IN)


def layer(h: DataFrame, edges: DataFrame, w: dict[str, np.ndarray], k: int) -> DataFrame:
    """One attention layer with its residual: elu(LayerNorm(sum + bias) + h). edges(src, dst, w); every node also sees itself with 1."""
    lin, a_src, a_dst, a_edge = w[f"{k}.lin"], w[f"{k}.src"], w[f"{k}.dst"], (w[f"{k}.edge"].reshape(HEADS, OUT) * w[f"{k}.att"]).sum(axis=1)

    def project(v: np.ndarray) -> np.ndarray:
        z = (v @ lin).reshape(-1, HEADS, OUT)
        return np.concatenate([z.reshape(-1, HIDDEN), (z * a_src).sum(axis=2), (z * a_dst).sum(axis=2)], axis=1)

    p = _map(h, project, HIDDEN)
    loops = p.select(F.col("uid").alias("src"), F.col("uid").alias("dst"), F.lit(1.0).alias("w"))
    e = edges.select("src", "dst", "w").unionByName(loops).join(p.select(F.col("uid").alias("src"), F.col("v").alias("s")), "src")
    e = e.join(p.select(F.col("uid").alias("dst"), F.slice("v", HIDDEN + HEADS + 1, HEADS).alias("t")), "dst")
    for n in range(HEADS):
        raw = F.get("s", HIDDEN + n) + F.get("t", n) + float(a_edge[n]) * F.log1p(F.greatest("w", F.lit(0.0)))
        e = e.withColumn(f"raw{n}", F.when(raw > 0, raw).otherwise(0.2 * raw))
    top = e.groupBy("dst").agg(*[F.max(f"raw{n}").alias(f"top{n}") for n in range(HEADS)])
    e = e.join(top, "dst").withColumns({f"e{n}": F.exp(F.greatest(F.col(f"raw{n}") - F.col(f"top{n}"), F.lit(-60.0))) for n in range(HEADS)})
    sums = e.groupBy("dst").agg(*[F.sum(F.col(f"e{i // OUT}") * F.get("s", i)).alias(f"m{i}") for i in range(HIDDEN)], *[F.sum(f"e{n}").alias(f"z{n}") for n in range(HEADS)])
    out = sums.select(F.col("dst").alias("uid"), F.array(*[F.col(f"m{i}") / (F.col(f"z{i // OUT}") + EPS) for i in range(HIDDEN)]).alias("m"))
    bias, gain, shift = (w[f"{k}.{n}"] for n in ("bias", "gain", "shift"))

    def finish(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        m = m + bias
        m = (m - m.mean(axis=1, keepdims=True)) / np.sqrt(m.var(axis=1, keepdims=True) + 1e-5) * gain + shift + v
        return np.where(m > 0, m, np.expm1(np.minimum(m, 0)))

    return _map(out.join(h, "uid").select("uid", "m", "v"), finish, HIDDEN)


def encode(nodes: DataFrame, edges: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    """(uid, v): embeddings that don't depend on the goal."""
    h = project_in(nodes, w)
    for k in range(LAYERS):
        h = layer(h, edges, w, k)
    return h


def feature_distance(nodes: DataFrame, goals: DataFrame, scale: float = 1.0) -> DataFrame:
    """(qid, uid, h): distance from the position that a node's first three features hold to the goal."""
    rows = nodes.select("uid", "f0", "f1", "f2").join(goals.select("qid", "g_x", "g_y", "g_z"), on=F.lit(True), how="inner")
    return rows.select("qid", "uid", (F.sqrt(sum((F.col(f"f{n}") - F.col(f"g_{k}")) ** 2 for n, k in enumerate("xyz"))) * scale).alias("h"))


def decode(h: DataFrame, nodes: DataFrame, goals: DataFrame, w: dict[str, np.ndarray], scale: float, w_unc: float = 0.5) -> DataFrame:
    """(qid, uid, h) for goals(qid, g_x, g_y, g_z): geometric distance, learned residual and uncertainty term."""
    rows = h.join(nodes.select("uid", "x", "y", "z", "f9"), "uid").join(goals.select("qid", "g_x", "g_y", "g_z"), on=F.lit(True), how="inner")
    relu = lambda x: np.maximum(x, 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            g = b[["g_x", "g_y", "g_z"]].to_numpy()
            v = np.stack(b["v"].to_numpy()) + relu(g @ w["goal.w1"] + w["goal.b1"]) @ w["goal.w2"] + w["goal.b2"]
            res = relu(relu(v @ w["mlp.w1"] + w["mlp.b1"]) @ w["mlp.w2"] + w["mlp.b2"]) @ w["mlp.w3"] + w["mlp.b3"]
            unc = (relu(b[["f9"]].to_numpy() @ w["unc.w1"] + w["unc.b1"]) @ w["unc.w2"] + w["unc.b2"])[:, 0]
            far = np.linalg.norm(b[["x", "y", "z"]].to_numpy() - g, axis=1) * scale
            yield pd.DataFrame({"qid": b["qid"], "uid": b["uid"], "h": far + res[:, 0] * scale + 0.15 * w_unc * np.logaddexp(0, unc)})

    return rows.mapInPandas(run, "qid long, uid long, h double")
