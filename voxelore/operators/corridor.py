"""Safety corridors around paths: sections of points, confidence to width, and tubes of six half-spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_POINTS, MAX_SECTIONS, MARGIN, MIN_WIDTH = 6, 6, 0.02, 0.05


def sections(points: DataFrame, max_points: int = MAX_POINTS, max_sections: int = MAX_SECTIONS) -> DataFrame:
    """points(qid, seq from 0, ...) -> a row for each point of each section; neighbours share an end, the last takes the tail."""
    n = F.count(F.lit(1)).over(W.partitionBy("qid"))
    of = lambda segment: F.least(F.floor(segment / (max_points - 1)), F.lit(max_sections - 1)).cast("int")
    rows = points.withColumn("n_points", n).where("n_points >= 2")
    first, last = of(F.greatest(F.col("seq") - 1, F.lit(0))), of(F.least(F.col("seq"), F.col("n_points") - 2))
    return rows.withColumn("section", F.explode(F.array_distinct(F.array(first, last)))).drop("n_points")


def width(confidence: Column, frontier: Column) -> Column:
    return F.when(frontier, 0.3 + 0.4 * confidence).otherwise(0.5 + 0.5 * confidence)


def section_widths(rows: DataFrame) -> DataFrame:
    """rows with node_type and f9 -> (qid, section, width), the mean width cut to [0, 1]; a missing confidence counts as 0.5."""
    w = width(F.coalesce("f9", F.lit(0.5)), F.coalesce("node_type", F.lit(0)) == 1)
    return rows.groupBy("qid", "section").agg(F.least(F.greatest(F.avg(w), F.lit(0.0)), F.lit(1.0)).alias("width"))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _norm(v: list[Column]) -> Column:
    return F.sqrt(sum(c * c for c in v))


def tubes(rows: DataFrame, widths: DataFrame, voxel_size: float, margin: float = MARGIN, min_width: float = MIN_WIDTH) -> DataFrame:
    """(qid, section, basis columns d0 .. v2, lo and hi of the three axes): half-spaces A p <= b with rows +-axis.

    Projections are of absolute coordinates, so that a tube always spans the origin sideways.
    """
    ends = rows.groupBy("qid", "section").agg(*[F.min_by(F.col(k), F.col("seq")).alias(f"a{k}") for k in "xyz"], *[F.max_by(F.col(k), F.col("seq")).alias(f"b{k}") for k in "xyz"])
    chord = [F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz"]
    ends = ends.withColumn("len", _norm(chord)).withColumns({f"d{n}": c / (F.col("len") + 1e-8) for n, c in enumerate(chord)})
    d = [F.col(f"d{n}") for n in range(3)]
    degenerate = F.col("len") < 1e-8
    helper = [F.when(degenerate, z).when(F.abs(d[0]) > 0.9, y).otherwise(x) for x, y, z in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))]
    ends = ends.withColumns({f"c{n}": c for n, c in enumerate(_cross(d, helper))})
    ends = ends.withColumn("cn", _norm([F.col(f"c{n}") for n in range(3)])).withColumns({f"u{n}": F.col(f"c{n}") / (F.col("cn") + 1e-8) for n in range(3)})
    ends = ends.withColumns({f"v{n}": c for n, c in enumerate(_cross(d, [F.col(f"u{n}") for n in range(3)]))})
    ends = ends.select("qid", "section", *[f"{a}{n}" for a in "duv" for n in range(3)]).join(widths, ["qid", "section"])
    on = rows.select("qid", "section", "x", "y", "z").join(ends, ["qid", "section"])
    on = on.withColumns({f"p{a}": sum(F.col(k) * F.col(f"{a}{n}") for n, k in enumerate("xyz")) for a in "duv"})
    pad = margin + 1.5 * voxel_size * (1 + 0.8 * (1 - F.col("width")))
    spans = [f(f"p{a}").alias(f"{n}_{a}") for a in "duv" for n, f in (("min", F.min), ("max", F.max))]
    out = on.groupBy("qid", "section", *[f"{a}{n}" for a in "duv" for n in range(3)], "width").agg(*spans).withColumn("pad", pad)
    out = out.withColumns({"lo_d": F.col("min_d") - F.col("pad"), "hi_d": F.col("max_d") + F.col("pad")})
    for a in "uv":
        lateral = F.greatest(F.greatest(F.abs(F.col(f"min_{a}")), F.abs(F.col(f"max_{a}"))) + F.col("pad"), F.lit(min_width))
        out = out.withColumns({f"lo_{a}": F.least(F.col(f"min_{a}") - F.col("pad"), -lateral), f"hi_{a}": F.greatest(F.col(f"max_{a}") + F.col("pad"), lateral)})
    return out.drop("pad", *[f"{n}_{a}" for a in "duv" for n in ("min", "max")])


def half_spaces(tube: DataFrame) -> DataFrame:
    """(qid, section, width, a, b): the six rows of A and b, those of the three axes before their opposites."""
    a = F.array(*[F.array(*[s * F.col(f"{axis}{n}") for n in range(3)]) for s in (F.lit(1.0), F.lit(-1.0)) for axis in "duv"])
    b = F.array(*[F.col(f"hi_{axis}") for axis in "duv"], *[-F.col(f"lo_{axis}") for axis in "duv"])
    return tube.select("qid", "section", "width", a.alias("a"), b.alias("b"))


def shrink(corridors: DataFrame, margin: float = MARGIN, min_width: float = MIN_WIDTH) -> DataFrame:
    """Rows of A normalised, and b reduced by the margin and the width that is missing."""
    norm = lambda r: F.greatest(F.sqrt(F.aggregate(r, F.lit(0.0), lambda t, x: t + x * x)), F.lit(1e-8))
    b = F.zip_with("b", "a", lambda v, r: v / norm(r) - margin - (1 - F.col("width")) * min_width)
    return corridors.withColumn("b", b).withColumn("a", F.transform("a", lambda r: F.transform(r, lambda x: x / norm(r))))
