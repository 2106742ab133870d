"""Training labels and the terms of the heuristic's loss as aggregates. Random choices are orders of a hash of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LENGTH, CLEARANCE, SMOOTHNESS, CURVATURE = 1.0, 3.0, 1.5, 1.6


def _order(*cols: str):
    """A pseudo-random order that other engines compute alike."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).cast("binary"))


def random_pairs(n_nodes: int, pairs: int, spark, seed: int = 42) -> DataFrame:
    """(pair, src, dst): two different nodes each, by a linear congruence of the pair's number."""
    i = F.col("id")
    a = (i * 1103515245 + seed * 12345 + 12345) % 2147483648 % n_nodes
    step = (i * 69069 + seed * 7 + 1) % 2147483648 % (n_nodes - 1) + 1
    return spark.range(pairs).select(i.alias("pair"), a.alias("src"), ((a + step) % n_nodes).alias("dst"))


def samples(costs: DataFrame, budget: int) -> DataFrame:
    """costs(goal, node, cost) -> distinct (goal, node, cost): cheap band, hard core and cheapest node, and background up to the budget."""
    ends = costs.groupBy("goal").agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"), F.count(F.lit(1)).alias("n"), F.min(F.struct("cost", "node")).alias("first"))
    rows = costs.join(ends.where("n >= 2 and hi > 0"), "goal")
    gap, span = F.col("cost") - F.col("lo"), F.col("hi") - F.col("lo")
    rows = rows.withColumns({"band": gap <= 0.2 * span, "hard": gap <= 0.01 * F.greatest(span, F.lit(1.0)), "special": F.col("node") == F.col("first.node")})
    rows = rows.withColumn("chosen", F.col("band") | F.col("hard") | F.col("special"))
    many = rows.groupBy("goal").agg((F.least(F.lit(budget), F.max("n")) - F.count_if("band") - F.count_if("hard") - 1).alias("left"))


    pool = rows.where("not chosen").join(many, "goal").withColumn("place", F.row_number().over(W.partitionBy("goal").orderBy(_order("goal", "node"), "node")))
    pool = pool.where(F.col("place") <= F.greatest(F.col("left"), F.lit(16)))
    return rows.where("chosen").select("goal", "node", "cost").unionByName(pool.select("goal", "node", "cost"))


def composite_target(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds target: cost with clearance, crowding and curvature terms of the node's features."""
    f = nodes.select(F.col("uid").alias("node"), "f3", "f4", "f5", "f14", "f15")
    clear = 1 - F.least(F.greatest("f15", F.lit(0.0)), F.lit(1.0))
    bend = F.sqrt(F.col("f3") ** 2 + F.col("f4") ** 2 + F.col("f5") ** 2)
    target = LENGTH * F.col("cost") + CLEARANCE * clear + SMOOTHNESS * F.greatest("f14", F.lit(0.0)) + CURVATURE * bend
    return rows.join(f, "node").withColumn("target", target).drop("f3", "f4", "f5", "f14", "f15")


def residual_scale(rows: DataFrame) -> DataFrame:
    return rows.groupBy("goal").agg(F.greatest(F.avg(F.abs("target")), F.lit(1.0)).alias("scale"), F.max("target").alias("top"))


def pointwise(rows: DataFrame) -> DataFrame:
    """rows(goal, node, pred, geo, target) -> (goal, mse, over): smooth-L1 of the scaled residuals, and the overestimate's penalty."""
    both = rows.join(residual_scale(rows), "goal")
    gap = F.abs((F.col("pred") - F.col("geo")) / F.col("scale") - (F.col("target") - F.col("geo")) / F.col("scale"))
    return both.groupBy("goal").agg(F.avg(F.when(gap < 1, 0.5 * gap * gap).otherwise(gap - 0.5)).alias("mse"), (0.1 * F.avg(F.greatest(F.col("pred") - F.col("target"), F.lit(0.0)))).alias("over"))


def ranking(rows: DataFrame) -> DataFrame:
    """(goal, rank): hinge on min(2048, 4 n) pairs of nodes, paired by a congruence of their places; 0 under 8 nodes."""


    placed = rows.select("goal", "node", "pred", "target", (F.row_number().over(W.partitionBy("goal").orderBy("node")) - 1).cast("long").alias("place"))
    sizes = rows.groupBy("goal").agg(F.count(F.lit(1)).alias("n")).join(residual_scale(rows), "goal").where("n >= 8")
    k = sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(2048), 4 * F.col("n")).cast("long") - 1)))
    pairs = k.select("goal", "scale", ((F.col("k") * 7919) % F.col("n")).alias("i"), ((F.col("k") * 104729 + 13) % F.col("n")).alias("j")).where("i <> j")
    side = lambda p: placed.select("goal", F.col("place").alias(p), F.col("pred").alias(f"p{p}"), F.col("target").alias(f"t{p}"))
    met = pairs.join(side("i"), ["goal", "i"]).join(side("j"), ["goal", "j"])
    true = F.col("tj") - F.col("ti")
    loss = F.greatest(0.05 - (F.col("pj") - F.col("pi")) / F.col("scale") * F.signum(true), F.lit(0.0))
    found = met.where(F.abs(true) > 0.005 * F.col("scale")).groupBy("goal").agg(F.avg(loss).alias("rank"))
    return rows.select("goal").distinct().join(found, "goal", "left").select("goal", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def monotonic(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(goal, mono): hinge over edges with both ends among the samples."""
    side = lambda p: rows.select("goal", F.col("node").alias(p), F.col("pred").alias(f"p_{p}"), F.col("target").alias(f"t_{p}"))
    met = edges.select("src", "dst").join(side("src"), "src").join(side("dst"), ["goal", "dst"]).join(residual_scale(rows), "goal")
    true = F.col("t_dst") - F.col("t_src")
    loss = F.greatest(0.02 * F.col("scale") - (F.col("p_dst") - F.col("p_src")) * F.signum(true), F.lit(0.0)) / F.col("scale")
    found = met.where(F.abs(true) > 1e-4).groupBy("goal").agg(F.avg(loss).alias("mono"))
    return rows.select("goal").distinct().join(found, "goal", "left").select("goal", F.coalesce("mono", F.lit(0.0)).alias("mono"))


def bias(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """ends(goal, start_h, goal_h) -> (goal, bias): the goal's value should be small and the start's near the greatest target."""
    both = residual_scale(rows).join(ends, "goal")
    a = F.greatest(F.col("goal_h") - 0.05 * F.col("scale"), F.lit(0.0))
    b = F.greatest(F.abs(F.col("top") - F.col("start_h")) - 0.1 * F.greatest("top", F.lit(1.0)), F.lit(0.0))
    return both.select("goal", (a + b).alias("bias"))


def total_loss(rows: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    parts = pointwise(rows).join(ranking(rows), "goal").join(monotonic(rows, edges), "goal").join(bias(rows, ends), "goal")
    return parts.withColumn("loss", F.col("mse") + F.col("over") + 0.2 * F.col("rank") + 0.1 * F.col("mono") + 0.05 * F.col("bias"))


def simple_loss(rows: DataFrame) -> DataFrame:
    """Mean squared error and half the mean overestimate."""
    d = F.col("pred") - F.col("target")
    return rows.agg((F.avg(d * d) + 0.5 * F.avg(F.greatest(d, F.lit(0.0)))).alias("loss"))
