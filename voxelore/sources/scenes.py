"""Scene and configuration sources, and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLY_TYPES = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4"}
#: Scalar settings that a scene may override.
SCENE_KEYS = ("voxel_size", "robot_radius", "density_high", "density_low", "truncation_sigma", "chunk_size", "hash_cell_size", "obs_expansion")


def parse_ply(raw: bytes) -> pd.DataFrame:
    """The vertices of a PLY file, little-endian binary or ASCII."""
    head, _, body = raw.partition(b"end_header\n")
    kind, count, fields, inside = "", 0, [], False
    for line in head.decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            fields.append((words[2], PLY_TYPES[words[1]]))
    if kind == "ascii":
        rows = [line.split()[: len(fields)] for line in body.decode("ascii").splitlines()[:count]]
        return pd.DataFrame(np.array(rows, float).reshape(-1, len(fields)), columns=[n for n, _ in fields])
    if kind != "binary_little_endian":
        raise ValueError(f"PLY format {kind!r} is not supported")
    return pd.DataFrame(np.frombuffer(body, np.dtype(fields), count))


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Gaussians of PLY files in the usual trained layout: log scales, a quaternion, a logit of opacity, first colour coefficients.

    (gid, x, y, z, xx .. zz, opacity, luminance); one file is read by one task, so large scenes should come as many files.
    gid: the file's place among the paths in order, times 2**32, plus the place in the file.
    """
    files = spark.read.format("binaryFile").load(path)
    # The listing of the files is on the driver anyway.
    number = {r.path: k for k, r in enumerate(files.select("path").orderBy("path").collect())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                v = parse_ply(raw)
                get = lambda k, d, v=v: v[k].to_numpy(float) if k in v else np.full(len(v), d)
                s = np.exp(2 * np.stack([get(f"scale_{k}", np.log(0.01)) for k in range(3)], axis=1))
                q = np.stack([get(f"rot_{k}", float(k == 0)) for k in range(4)], axis=1)
                w, i, j, k = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).T
                r = np.array([[1 - 2 * (j * j + k * k), 2 * (i * j - w * k), 2 * (i * k + w * j)], [2 * (i * j + w * k), 1 - 2 * (i * i + k * k), 2 * (j * k - w * i)], [2 * (i * k - w * j), 2 * (j * k + w * i), 1 - 2 * (i * i + j * j)]])
                cov = np.einsum("abn,nb,cbn->acn", r, s, r)
                lum = np.clip(0.5 + 0.28209479177387814 * np.mean([get(f"f_dc_{n}", 0.0) for n in range(3)], axis=0), 0, 1)
                yield pd.DataFrame({"gid": np.arange(len(v)) + (number[name] << 32), "x": get("x", 0), "y": get("y", 0), "z": get("z", 0), "xx": cov[0, 0], "xy": cov[0, 1], "xz": cov[0, 2], "yy": cov[1, 1], "yz": cov[1, 2], "zz": cov[2, 2], "opacity": 1 / (1 + np.exp(-get("opacity", 40.0))), "luminance": lum})

    return files.select("path", "content").mapInPandas(run, "gid long, x double, y double, z double, xx double, xy double, xz double, yy double, yz double, zz double, opacity double, luminance double")


def read_pairs(texts: DataFrame) -> DataFrame:
    """texts(value), each a JSON array of {"start": .., "goal": ..} or [start, goal] items -> (pair, s_x .. g_z); other items are skipped."""
    items = texts.select(F.posexplode(F.from_json("value", "array<string>")).alias("pair", "item"))
    named = F.from_json("item", "struct<start: array<double>, goal: array<double>>")
    plain = F.from_json("item", "array<array<double>>")
    rows = items.withColumns({"start": F.coalesce(named["start"], F.get(plain, 0)), "goal": F.coalesce(named["goal"], F.get(plain, 1))})
    rows = rows.where((F.size("start") == 3) & (F.size("goal") == 3))
    return rows.select("pair", *[F.get(c, n).alias(f"{p}_{k}") for c, p in (("start", "s"), ("goal", "g")) for n, k in enumerate("xyz")])


def random_queries(spark: SparkSession, lower: tuple, upper: tuple, n: int, margin: float = 0.1, least: float = 0.3, seed: int = 42) -> DataFrame:
    """n start and goal pairs, uniform within the bounds less the margin and at least `least` apart.

    The numbers are hashes of seed and row, the same however rows are dealt over partitions. An error where the bounds are
    too narrow for pairs that far apart.
    """
    spread = [max(u - lo - 2 * margin, 0.0) for lo, u in zip(lower, upper, strict=True)]
    far = F.sqrt(sum((F.col(f"s_{k}") - F.col(f"g_{k}")) ** 2 for k in "xyz")) >= least
    tried = 8 * n
    while tried <= 8192 * max(n, 1):
        many = spark.range(tried)
        for at, p in enumerate(("s", "g")):
            for k, lo in enumerate(lower):
                part = F.pmod(F.xxhash64(F.lit(seed), F.lit(3 * at + k), F.col("id")), F.lit(1 << 53)) / float(1 << 53)
                many = many.withColumn(f"{p}_{'xyz'[k]}", lo + margin + part * spread[k])
        found = many.where(far).orderBy("id").limit(n).withColumnRenamed("id", "qid")
        if found.count() == n:
            return found
        tried *= 4
    raise ValueError(f"no {n} pairs at least {least} apart within the bounds")


def baseline_queries(spark: SparkSession, lower: tuple, upper: tuple, n: int = 50, seed: int = 42) -> DataFrame:
    """Queries of the baselines: as `random_queries`, with a margin of a tenth of the greatest extent."""
    return random_queries(spark, lower, upper, n, margin=0.1 * max(u - lo for lo, u in zip(lower, upper, strict=True)), seed=seed)


def scene_config(config: dict, scene: str | None) -> dict:
    """Settings with a scene's overrides: known scalars replace, the `edge` settings merge key by key."""
    base, own = dict(config.get("gs_to_graph", {})), (config.get("scenes", {}).get(scene) or {}) if scene else {}
    base |= {k: own[k] for k in SCENE_KEYS if k in own}
    if isinstance(own.get("edge"), dict):
        base["edge"] = {**base.get("edge", {}), **own["edge"]}
    return base


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def dumps(stats: DataFrame) -> str:
    """A small table (counts by type) as one JSON object."""
    return json.dumps({r.name: r.n for r in stats.collect()}, sort_keys=True)
