"""Heuristic search: one sequential search a query, queries in parallel, the graph as arrays in each worker.

A graph is sent to the workers only up to MAX_EDGES edges (about 300 MB); beyond that `astar` refuses and
`paths.shortest_costs`, which is distributed, is the way to costs.
"""

from __future__ import annotations

import heapq
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelore.operators import paths

MAX_EDGES = 5_000_000
CLOCKED = 256


@dataclass(frozen=True)
class Costs:
    """Weights of the search's cost terms."""

    z_penalty: float = 1.2
    z_reference: float = 0.0
    length_penalty: float = 0.5
    line_bias: float = 0.0
    z_slope: float = 1.5
    z_curvature: float = 1.8
    z_goal_soft: float = 1.4
    max_expand: int = 10_000
    #: Seconds that one query's search may take; looked at before it and every CLOCKED nodes.
    max_seconds: float = float("inf")


class Graph:
    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        nodes = nodes.sort_values("uid")
        self.xyz = nodes[["x", "y", "z"]].to_numpy()
        self.kind = nodes["node_type"].to_numpy()
        self.local = nodes["local_id"].to_numpy()
        edges = edges.sort_values(["src", "dst"])
        self.start = np.searchsorted(edges["src"].to_numpy(), np.arange(len(nodes) + 1))
        self.dst = edges["dst"].to_numpy()
        #: What an edge costs whatever the query: weight and obstacle term; its length and rise apart.
        self.fixed, self.len, self.dz = (edges["w"] + edges["penalty"]).to_numpy(), edges["len"].to_numpy(), edges["dz"].to_numpy()


def _to_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ab = b - a
    n = float(ab @ ab)
    t = np.clip((p - a) @ ab / n, 0, 1) if n > 1e-12 else np.zeros(len(p))
    return np.linalg.norm(p - a - t[:, None] * ab, axis=1)


def search(g: Graph, s: int, goal: int, start: np.ndarray, end: np.ndarray, h: np.ndarray, c: Costs) -> tuple[list[int], int, str, float]:
    """(unified ids of the path, expanded, reason, cost). Best-first by f = g + h with no reopening; ties by g, then type and local id."""
    began = time.monotonic()
    z_mid = (start[2] + end[2]) / 2
    at_node = (c.z_reference + max(c.z_goal_soft, 0)) * np.abs(g.xyz[:, 2] - z_mid) + (c.line_bias * _to_segment(g.xyz, start, end) if c.line_bias else 0)
    edge = g.fixed + c.length_penalty * g.len + c.z_penalty * g.dz
    best, came, closed = {s: 0.0}, {s: -1}, set()
    heap = [(h[s], 0.0, g.kind[s], g.local[s], s, -1)]
    expanded = 0
    while heap:
        if expanded % CLOCKED == 0 and time.monotonic() - began >= c.max_seconds:
            return [], expanded, "time limit", float("nan")
        _, cost, _, _, u, before = heapq.heappop(heap)
        if u in closed:
            continue
        closed.add(u)
        came[u] = before
        if u == goal:
            path = [u]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            return path[::-1], expanded, "ok", cost
        expanded += 1
        if expanded > c.max_expand:
            return [], expanded, "expansion limit", float("nan")
        for k in range(g.start[u], g.start[u + 1]):
            v = g.dst[k]
            if v in closed:
                continue
            step = edge[k] + at_node[v]
            if before >= 0:
                z0, z1, z2 = g.xyz[before, 2], g.xyz[u, 2], g.xyz[v, 2]
                step += c.z_slope * (abs(z1 - z0) + abs(z2 - z1)) + c.z_curvature * abs(z2 - 2 * z1 + z0)
            new = cost + step
            if new < best.get(v, float("inf")):
                best[v] = new
                heapq.heappush(heap, (new + h[v], new, g.kind[v], g.local[v], v, u))
    return [], expanded, "no path", float("nan")


RESULT = "qid long, success boolean, reason string, nodes_expanded long, cost double, start_snap double, goal_snap double, path array<long>"


def astar(queries: DataFrame, snaps: DataFrame, nodes: DataFrame, adjacency: DataFrame, scale: DataFrame, costs: Costs = Costs(), alpha: float = 1.0, uncertain: bool = True, learned: DataFrame | None = None) -> DataFrame:
    """One row a query. learned(qid, uid, h): estimates to use, times alpha and 0 at least; the hand-made ones serve where a query has none, or
    where one is missing or not finite. snaps: (pid, uid, d) of starts (2 qid) and goals (2 qid + 1); a snap beyond the limit fails the query."""
    spark = queries.sparkSession
    if (n := adjacency.count()) > MAX_EDGES:
        raise ValueError(f"{n} edges are too many to search in one task; use paths.shortest_costs")
    graph = spark.sparkContext.broadcast(Graph(nodes.select("uid", "x", "y", "z", "node_type", "local_id").toPandas(), adjacency.select("src", "dst", "w", "len", "dz", "penalty").toPandas()))
    conf = nodes.select("uid", "f9", "f11").toPandas().sort_values("uid")
    extra = spark.sparkContext.broadcast(alpha * (1 - conf["f9"].to_numpy()) + 0.5 * conf["f11"].to_numpy() if uncertain else np.zeros(len(conf)))
    ends = [snaps.where(F.col("pid") % 2 == k).select(F.floor(F.col("pid") / 2).alias("qid"), F.col("uid").alias(f"{p}_uid"), F.col("d").alias(f"{p}_snap")) for k, p in ((0, "start"), (1, "goal"))]
    rows = queries.join(ends[0], "qid").join(ends[1], "qid").crossJoin(F.broadcast(scale))  # one row

    def run(group: pd.DataFrame, own: pd.DataFrame | None) -> pd.DataFrame:
        g, out = graph.value, []
        for r in group.itertuples():
            base = {"qid": r.qid, "start_snap": r.start_snap, "goal_snap": r.goal_snap}
            if max(r.start_snap, r.goal_snap) > paths.MAX_SNAP:
                out.append(base | {"success": False, "reason": "snap too far", "nodes_expanded": 0, "cost": None, "path": []})
                continue
            start, end = np.array([r.s_x, r.s_y, r.s_z]), np.array([r.g_x, r.g_y, r.g_z])
            h = np.maximum(np.linalg.norm(g.xyz - end, axis=1) * r.scale + extra.value, 0)
            if own is not None:
                given = np.full(len(h), np.nan)
                given[own["uid"].to_numpy()] = own["h"].to_numpy()
                h = np.where(np.isfinite(given), np.maximum(alpha * given, 0), h)
            path, expanded, reason, cost = search(g, r.start_uid, r.goal_uid, start, end, h, costs)
            out.append(base | {"success": bool(path), "reason": reason, "nodes_expanded": expanded, "cost": cost if path else None, "path": [int(x) for x in path]})
        return pd.DataFrame(out, columns=[field.split()[0] for field in RESULT.split(", ")])

    if learned is not None:
        kept = learned.join(rows.select("qid"), "qid", "left_semi").select("qid", "uid", "h")
        return rows.groupBy("qid").cogroup(kept.groupBy("qid")).applyInPandas(run, RESULT)
    return rows.groupBy("qid").applyInPandas(lambda group: run(group, None), RESULT)


def path_points(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, seq, uid, node_type, local_id, x, y, z) of the paths found."""
    steps = results.select("qid", F.posexplode("path").alias("seq", "uid"))
    return paths.materialise(steps, nodes)
