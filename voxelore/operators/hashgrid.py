"""A spatial hash of Gaussians as a table of cells: build, radius candidates, nearest among candidates, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelore.plans.store import written

#: Gaussians in a list, pairs that a task writes and tasks at most.
LISTED, PAIRS_A_TASK, MOST_TASKS = 4096, 10_000_000, 20_000

def _cells(df: DataFrame, radius: Column, origin: dict[str, float], cell: float) -> DataFrame:
    for k in "xyz":
        lo, hi = F.floor((F.col(k) - radius - origin[k]) / cell), F.ceil((F.col(k) + radius - origin[k]) / cell)
        df = df.withColumn(f"c{k}", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    return df


def reach() -> Column:
    return 3 * F.sqrt(F.greatest("xx", "yy", "zz"))


def origin_of(gaussians: DataFrame) -> dict[str, float]:
    """The least corner of all reaches; one row comes to the driver."""
    r = gaussians.agg(*[F.min(F.col(k) - reach()).alias(k) for k in "xyz"]).first()
    return {k: r[k] if r[k] is not None else 0.0 for k in "xyz"}


def build(gaussians: DataFrame, cell: float, origin: dict[str, float]) -> DataFrame:
    """(cx, cy, cz, gid): each Gaussian in every cell that its reach touches."""
    return _cells(gaussians, reach(), origin, cell).select("cx", "cy", "cz", "gid")


def _boxed(df: DataFrame, key: str, radius: Column, origin: dict[str, float], cell: float) -> DataFrame:
    """(key, box): the first and last cells on each axis that the rows touch; rows with a null coordinate touch none."""
    ends = [f((F.col(k) + sign * radius - origin[k]) / cell).cast("long").alias(f"{e}{k}") for k in "xyz" for e, f, sign in (("lo", F.floor, -1), ("hi", F.ceil, 1))]
    return df.where(" and ".join(f"{k} is not null" for k in "xyz")).select(key, F.struct(*ends).alias("box"))


def _in_cells(boxes: DataFrame) -> DataFrame:
    for k in "xyz":
        boxes = boxes.withColumn(f"c{k}", F.explode(F.sequence(f"box.lo{k}", f"box.hi{k}")))
    return boxes


def candidates(gaussians: DataFrame, points: DataFrame, cell: float, origin: dict[str, float], radius: float | None = None) -> DataFrame:
    """points(pid, x, y, z) -> distinct (pid, gid) that share a cell.

    Cells are compared once for each pair of different boxes, in the least cell that both hold. Each set of boxes that a
    point has gets lists of its Gaussians, LISTED on average at most, that are exploded beside the points with that set.
    """
    own = _boxed(points, "pid", F.lit(cell if radius is None else radius), origin, cell)
    own = own.groupBy("pid").agg(F.sort_array(F.collect_set("box")).alias("boxes"))
    other = _boxed(gaussians, "gid", reach(), origin, cell).distinct()
    n_own, n_other = own.count(), other.count()
    n_lists, tasks = -(-max(n_other, 1) // LISTED), min(1 + n_own * n_other // PAIRS_A_TASK, MOST_TASKS)
    least = F.lit(True)
    for k in "xyz":
        least = least & (F.col(f"c{k}") == F.greatest(f"box.lo{k}", f"g_box.lo{k}"))
    sets = _in_cells(own.select("boxes").distinct().withColumn("box", F.explode("boxes")))
    cells = _in_cells(other.select("box").distinct()).withColumnRenamed("box", "g_box")
    meet = sets.join(cells, ["cx", "cy", "cz"]).where(least).select("boxes", "g_box")
    part = F.pmod(F.xxhash64("gid"), F.lit(n_lists)).alias("part")
    lists = meet.join(other.withColumnRenamed("box", "g_box"), "g_box").groupBy("boxes", part).agg(F.collect_set("gid").alias("gids"))
    # The number of tasks follows the pairs, as the lists themselves are small.
    rows = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_lists - 1)).cast("array<bigint>")))
    both = rows.repartition(tasks, "boxes", "part").join(lists.repartition(tasks, "boxes", "part"), ["boxes", "part"])
    return both.select("pid", F.explode("gids").alias("gid"))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("pid").orderBy("d", "gid"))).where(F.col("rank") <= k)


def _with_d(points: DataFrame, gaussians: DataFrame, on: str | list[str]) -> DataFrame:
    at = gaussians.withColumnsRenamed({a: f"g_{a}" for a in "xyz"})
    d = F.sqrt(sum((F.col(a) - F.col(f"g_{a}")) ** 2 for a in "xyz"))
    return points.join(at, on).withColumn("d", d)


def nearest(gaussians: DataFrame, points: DataFrame, cell: float, origin: dict[str, float], radius: float, k: int) -> DataFrame:
    """(pid, rank, gid, d): the k candidates with the nearest means, ties by gid.

    A point looks among the Gaussians of 27 finer cells of an edge that suits the density about it. If k are nearer than that edge,
    none nearer is elsewhere, and as the edge is under the radius and the least reach together, all of them are candidates.
    All other points, in thin parts, have all their candidates compared.
    """
    at = gaussians.select("gid", "x", "y", "z")
    n, least = gaussians.agg(F.count(F.lit(1)), F.min(reach())).first()
    edge = 0.999 * (radius + (least or 0.0))
    levels = min(20, n.bit_length() // 3)
    size = F.lit(edge) / F.pow(F.lit(2.0), F.col("level"))
    fine = lambda df: df.withColumns({f"c{a}": F.floor(F.col(a) / size) for a in "xyz"})
    everywhere = lambda df: fine(df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))))
    key = ["level", "cx", "cy", "cz"]
    # Of equal means only the k least gids can be among the nearest.
    some = everywhere(at.withColumn("n", F.row_number().over(W.partitionBy("x", "y", "z").orderBy("gid"))).where(F.col("n") <= k).drop("n"))
    full = some.groupBy(*key).count().where(F.col("count") >= k).drop("count")
    once = points.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), *[F.first(a).alias(a) for a in "xyz"]).where("n = 1").drop("n")
    level = everywhere(once).join(full, key).groupBy("pid").agg(F.max("level").alias("level"), *[F.first(a).alias(a) for a in "xyz"])
    around = fine(level)
    for a in "xyz":
        around = around.withColumn(f"c{a}", F.explode(F.array(*[F.col(f"c{a}") + s for s in (-1, 0, 1)])))
    found = _ranked(_with_d(around, some, key).select("pid", "gid", "d", "level"), k)
    ends = W.partitionBy("pid")
    found = found.withColumns({"n": F.count(F.lit(1)).over(ends), "far": F.max("d").over(ends)})
    found = written(found.where((F.col("n") == k) & (F.col("far") < size * (1 - 1e-9))).select("pid", "rank", "gid", "d"), "hash-near")
    rest = written(points.join(found.where("rank = 1").select("pid"), "pid", "left_anti"), "hash-rest")
    pairs = candidates(gaussians, rest, cell, origin, radius).join(rest, "pid")
    return found.unionByName(_ranked(_with_d(pairs, at, "gid"), k).select("pid", "rank", "gid", "d"))


def stats(table: DataFrame) -> DataFrame:
    per = table.groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_entries"), F.max("n").alias("max_per_cell"), *[(F.max(f"c{k}") + 1).alias(f"dim_{k}") for k in "xyz"])
