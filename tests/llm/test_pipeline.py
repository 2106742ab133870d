"""The pipeline's stages on the smallest tables."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, DATA), f"test-{name}")
        assert out.columns == docs.columns
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= left and now
        docs, left = out, now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left
