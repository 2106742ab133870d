"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantised(c: Column | str, scale: float = 1e6) -> Column:
    """A double as a whole number of 1/scale, as sums of doubles depend on their order in the last bits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("long")


def steady_sum(c: Column, parts: float = 2.0**20) -> Column:
    """A sum of doubles that doesn't depend on their order: multiples of 1/parts add up without rounding, the rests hardly round."""
    whole = F.rint(c * F.lit(parts)) / F.lit(parts)
    return F.sum(whole) + F.sum(c - whole)


def distance(a: str, b: str) -> Column:
    """Between points in the columns a_x, a_y, a_z and b_x, b_y, b_z; an empty prefix stands for x, y, z."""
    at = lambda p, k: F.col(f"{p}_{k}" if p else k)
    return F.sqrt(sum((at(a, k) - at(b, k)) ** 2 for k in "xyz"))


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))


def numbered(df: DataFrame, key: str, out: str, groups: list[str] = (), block: int = 1 << 16) -> DataFrame:
    """Adds `out`, the place (from 0) of each row by `key` within its groups.

    Places within blocks of keys plus a prefix sum over the blocks' counts, so that no task sorts the whole table.
    """
    groups, at = list(groups), f"{out}_block"
    df = df.withColumn(at, F.floor(F.col(key) / block))
    counts = df.groupBy(*groups, at).agg(F.count(F.lit(1)).alias("n_in_block"))
    before = W.partitionBy(*(groups or [F.lit(0)])).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*groups, at, F.coalesce(F.sum("n_in_block").over(before), F.lit(0)).alias("n_before"))
    own = F.row_number().over(W.partitionBy(*groups, at).orderBy(key))
    return df.join(counts, [*groups, at]).withColumn(out, (F.col("n_before") + own - 1).cast("long")).drop(at, "n_before")


