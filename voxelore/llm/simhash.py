"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most r bits apart share a variant within r/2 bits of each, and two that share such a variant are
at most r apart. Every distinct fingerprint therefore goes to the key of each variant in its half-radius ball; equal
variants meet in one task. Variants are shuffled by their leading bits: a fingerprint is sent once to every prefix that
some variant of it has, with the flips it has left, and the receiving task writes out the variants under its prefix. That
is the same set of variants in far fewer shuffled rows (56 a fingerprint for 10 bits and half radius 2, instead of 2081).

The fingerprints that share a variant are linked to the least of them, never pair by pair, checked by their Hamming
distance, and thinned to a spanning forest of the task; the forests are joined into components. All fingerprints take
part, without a cap: a task whose variants exceed its memory budget goes through them by longer prefixes.

Defined cases: a null text is the empty text; a text without words has fingerprint zero and is linked like any other. A
null id ranks above all others as a component's name. Repeated rows are each reported. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from voxelore.llm.components import connected_components
from voxelore.llm.store import written

#: Shingles and variants that a task holds at a time.
SHINGLES_AT_ONCE, VARIANTS_AT_ONCE = 1 << 16, 1 << 21


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is set if it is in over half of the shingles' hashes."""
    parts = text.lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = list(accumulate(len(w) + 1 for w in parts))
    starts = [0, *ends]
    last = ends[words - 1 :] or ends[-1:]
    counts, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, SHINGLES_AT_ONCE):
        block = b"".join([xxh64_digest(whole[a : b - 1], seed) for a, b in zip(starts[at : at + SHINGLES_AT_ONCE], last[at : at + SHINGLES_AT_ONCE], strict=False)])
        bits = np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x or b"") for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; fp is the unsigned fingerprint in a signed long."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return docs.mapInArrow(_fingerprints, "id long, fp long")


def _masks(bits: int, most: int) -> np.ndarray:
    """All masks of `bits` bits with at most `most` set, by number of set bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def _meet(fps: np.ndarray, left: np.ndarray, low: int, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Star links among fps that share a variant. All variants here agree above the `low` free bits; left: flips left."""
    if len(fps) < 2:
        return
    size = sum(int((left == k).sum()) * len(_masks_of(low, k)) for k in range(int(left.max()) + 1))
    if size > VARIANTS_AT_ONCE and low > 8:
        step = 4
        part = (fps >> np.uint64(low - step)) & np.uint64(15)
        for sub in range(16):
            over = left - np.bitwise_count(part ^ np.uint64(sub)).astype(np.int64)
            if (ok := over >= 0).sum() > 1:
                _meet(fps[ok], over[ok], low - step, out)
        return
    under = np.uint64((1 << low) - 1)
    variants, who = [], []
    for k in range(int(left.max()) + 1):
        at = np.flatnonzero(left == k)
        masks = _masks_of(low, k)
        variants.append(((fps[at] & under)[:, None] ^ masks[None, :]).ravel())
        who.append(np.repeat(at, len(masks)))
    variants, who = np.concatenate(variants), np.concatenate(who)
    order = np.argsort(variants)
    variants, who = variants[order], who[order]
    first = np.concatenate([[True], variants[1:] != variants[:-1]])
    starts = np.flatnonzero(first)
    if len(starts) == len(variants):
        return
    heads = np.repeat(np.minimum.reduceat(who, starts), np.diff(np.append(starts, len(who))))
    met = np.unique(np.stack([heads[heads != who], who[heads != who]]), axis=1)
    out.append((fps[met[0]], fps[met[1]]))


_KEPT_MASKS: dict[tuple[int, int], np.ndarray] = {}


def _masks_of(bits: int, most: int) -> np.ndarray:
    if (bits, most) not in _KEPT_MASKS:
        _KEPT_MASKS[bits, most] = _masks(bits, most)
    return _KEPT_MASKS[bits, most]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) by label propagation with pointer jumping."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _links(prefix_bits: int, radius: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        fps, left = group["fp"].to_numpy().view(np.uint64), group["left"].to_numpy(np.int64)
        _meet(fps, left, 64 - prefix_bits, found)
        if not found:
            return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        near = np.bitwise_count(u ^ v) <= radius
        nodes, roots = _forest(u[near], v[near])
        other = nodes != roots
        return pd.DataFrame({"u": nodes[other].view(np.int64), "v": roots[other].view(np.int64)})

    return links


def near_links(classes: DataFrame, radius: int = 4, prefix_bits: int = 10) -> DataFrame:
    """classes(fp), distinct -> (u, v): links whose components are those of all pairs at most `radius` bits apart."""
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even, so that two half balls meet exactly at it")
    masks = [(int(m), half - int(m).bit_count()) for m in _masks(prefix_bits, half)]
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("left")) for m, k in masks])
    sent = classes.select("fp", F.explode(flips).alias("to"))
    sent = sent.select("fp", F.shiftrightunsigned("fp", 64 - prefix_bits).bitwiseXOR(F.col("to.mask")).alias("prefix"), F.col("to.left").alias("left"))
    return sent.groupBy("prefix").applyInPandas(_links(prefix_bits, radius), "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(id, fp, root, component_id) for each row; root: the least fingerprint of its group, component_id: the least id."""
    members = written(fingerprints(docs, id_col, text_col), "simhash-members")
    classes = written(members.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = written(connected_components(near_links(classes.select("fp"), radius)), "simhash-roots")
    named = roots.join(classes, roots["node"] == classes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(named, "root").select(F.col("node").alias("fp"), "root", "component_id")
    names = classes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return members.join(names, "fp").select("id", "fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(id, fp, component_id): the least id that can be reached over links of at most `radius` differing bits."""
    return _grouped(docs, id_col, text_col, radius).select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row of docs for each group of near-duplicates, one whose id names the group.

    Where that id has several rows, one with the least fingerprint among the group's stays, whichever of equal ones. Null
    ids are an id like any other, named only where a group has no other. Further columns pass through untouched, whatever
    their names. An empty table gives an empty result.
    """
    groups = written(_grouped(docs, id_col, text_col, radius), "simhash-groups")
    heads = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("fp", "id")).alias("head"))
    lead = "__"
    while any(c.startswith(lead) for c in docs.columns):
        lead += "_"
    here, print_of, key = f"{lead}id", f"{lead}fp", f"{lead}key"
    rows_of = groups.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.select(F.col("head.id").alias("id"), F.col("head.fp").alias("fp")).join(rows_of.withColumnRenamed("id", "same"), F.col("id").eqNullSafe(F.col("same")))
    heads = written(heads.select(F.col("id").alias(here), F.col("fp").alias(print_of), "n"), "simhash-heads")
    single, several = heads.where("n = 1").select(here), heads.where("n > 1").select(here, print_of)
    alone = docs.join(single, docs[id_col].cast("long").eqNullSafe(single[here]), "left_semi")
    if several.isEmpty():
        return alone
    # Ids with several rows: their fingerprints say which of the rows is meant.
    ids = several.select(here).distinct()
    own = docs.join(ids, docs[id_col].cast("long").eqNullSafe(ids[here]), "left_semi").withColumn(key, F.xxhash64(F.col(text_col)))
    prints = own.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(key).alias("k")).distinct()
    prints = prints.mapInArrow(_fingerprints, "id long, fp long, k long").join(several, F.col("id").eqNullSafe(F.col(here)) & (F.col("fp") == F.col(print_of)))
    prints = prints.select(F.col("id").alias(here), F.col("k").alias(f"{key}2"), F.col("fp").alias(print_of))
    found = own.join(prints, own[id_col].cast("long").eqNullSafe(prints[here]) & (own[key] == prints[f"{key}2"])).dropDuplicates([here, print_of])
    return alone.unionByName(found.select(*[F.col(f"`{c}`") for c in docs.columns]))
