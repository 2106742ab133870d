"""A leaf gets all its budget, though a document crosses it."""

from pyspark.sql import functions as F

from voxelore.llm import mixing


def test_the_crossing_document_is_cut_to_the_budget(spark):
    rows = [(k, "a\tb  c\n" * (400 if k % 9 == 0 else k % 5), f"src{k % 3}") for k in range(60)] + [(7, "x y", "src1"), (7, "x y", "src1"), (None, None, "src2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    levels = {"source": F.col("source")}
    budget = {r.source: r.budget for r in mixing.select_mix(d, levels, share=0.3, cut=True).collect()}
    got = mixing.mixed_rows(d, levels, share=0.3)
    taken = {r.source: r.n for r in got.groupBy("source").agg(F.sum(mixing.words(F.col("text")) + 1).alias("n")).collect()}
    assert taken == budget and sum(budget.values()) > 500
    texts = {(i, s): t or "" for i, t, s in rows}
    assert all(texts[r.doc_id, r.source].startswith(r.text or "") or r.doc_id == 7 for r in got.collect())
    short = {r.source: r.n for r in mixing.select_mix(d, levels, share=0.3).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert sum(short.values()) < sum(budget.values())
