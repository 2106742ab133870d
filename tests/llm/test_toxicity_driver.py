"""The driver of the toxicity training holds the weights only; documents and the fit stay on the executors."""

from pyspark import TaskContext
from pyspark.sql import functions as F

from voxelore.llm import toxicity

DATA = "/root/testdata/sf0.001"


def test_driver_does_not_fit(spark, monkeypatch):
    def fit(*args, own=toxicity.fit):
        assert TaskContext.get() is not None, "fitted in the driver"
        return own(*args)

    monkeypatch.setattr(toxicity, "fit", fit)
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert len(model.terms) and model.w.shape == model.terms.shape and model.v.shape == (len(model.terms), toxicity.FACTORS)
    assert (model.terms[1:] > model.terms[:-1]).all()
    scores = toxicity.score(docs, model).join(labels, "doc_id").groupBy("toxic").agg(F.avg("score")).collect()
    assert dict(scores)[1] > 0.5 > dict(scores)[0]


def test_no_term_is_frequent_enough(spark):
    docs = spark.createDataFrame([(k, f"word{k}") for k in range(40)], "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def test_only_the_most_telling_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"same {'bad' if k % 2 else 'fine'} {k % 7}") for k in range(80)], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "MOST_TERMS", 2)
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert set(model.terms.tolist()) == {toxicity._hash(b"wbad"), toxicity._hash(b"wfine")}
