"""A pair of terms that are neutral alone and not among the most frequent ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from voxelore.llm import toxicity
from voxelore.llm.text import in_fold


def test_pairs_of_neutral_terms_are_learnt(spark):
    random.seed(7)
    plain, rows = [f"w{k}" for k in range(100)], []
    for k in range(2000):
        w, u = random.choices(plain, k=40), random.random()
        if u < 0.05:
            w[4], w[30] = "nitwit", "folk"
        elif u < 0.2:
            w[5] = "scoundrel"
        elif u < 0.6:
            w[4] = "nitwit" if u < 0.4 else "folk"
        rows.append((k, " ".join(w), int(u < 0.2)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d.drop("toxic"), d.drop("text"))
    assert {toxicity._hash(b"w" + w) for w in (b"nitwit", b"folk", b"scoundrel", b"w7")} <= set(model.terms.tolist())
    held = d.where(in_fold(F.col("doc_id"), 5) == 0)
    got = {r.doc_id: r.score for r in toxicity.score(held, model).collect()}
    pairs = [got[r.doc_id] for r in held.collect() if "nitwit" in r.text and "folk" in r.text]
    single = [got[r.doc_id] for r in held.collect() if ("nitwit" in r.text) != ("folk" in r.text)]
    assert np.mean(np.array(pairs) >= 0.5) > 0.7 and np.mean(np.array(single) >= 0.5) < 0.02
