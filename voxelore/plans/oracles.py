"""The same queries as SQL for DuckDB, written independently: brute-force joins where the operators generate or bucket."""

from __future__ import annotations

_Q = "cast(floor(({0}) * 1e6 + 0.5::double) AS bigint) AS {1}"
_Q3 = "cast(floor(({0}) * 1e3 + 0.5::double) AS bigint) AS {1}"


def q(expr: str, name: str | None = None) -> str:
    return _Q.format(expr, name or expr)


def qs(*names: str) -> str:
    return ", ".join(q(n) for n in names)


def _e(k: int) -> str:
    return f"embedding[{k}]::double"


def _sig(k: int) -> str:
    return f"1.0::double / (1.0::double + exp(-4.0::double * {_e(k)}))"


BASE = f"""
g AS (SELECT vec_id AS gid, {_e(1)} AS x, {_e(2)} AS y, {_e(3)} AS z,
             0.02::double + 0.1::double * abs({_e(4)}) AS sx, 0.02::double + 0.1::double * abs({_e(5)}) AS sy, 0.02::double + 0.1::double * abs({_e(6)}) AS sz,
             {_sig(7)} AS op, ({_sig(8)} + {_sig(9)} + {_sig(10)}) / 3.0::double AS lum FROM embeddings),
gw AS (SELECT *, op / sqrt(pow(2.0::double * pi(), 3) * greatest(sx*sx*sy*sy*sz*sz, 1e-30)) AS wg,
              least(1e6, op / sqrt(pow(2.0::double * pi(), 3) * greatest(sx*sx*sy*sy*sz*sz, 1e-12))) AS w FROM g),
b AS (SELECT min(x) - 0.16::double AS lx, min(y) - 0.16::double AS ly, min(z) - 0.16::double AS lz,
             max(x) + 0.16::double AS ux, max(y) + 0.16::double AS uy, max(z) + 0.16::double AS uz FROM g),
b2 AS (SELECT *, greatest(ceil((ux - lx) / 0.08::double), 10)::bigint AS rx, greatest(ceil((uy - ly) / 0.08::double), 10)::bigint AS ry,
              greatest(ceil((uz - lz) / 0.08::double), 10)::bigint AS rz FROM b),
m AS (SELECT *, (ux - lx) / rx AS cx, (uy - ly) / ry AS cy, (uz - lz) / rz AS cz FROM b2),
mm AS (SELECT *, sqrt(cx*cx + cy*cy + cz*cz) AS diag, lz + greatest(0.02::double, cz) AS zfloor FROM m),
ax AS (SELECT unnest(range(rx)) AS ix FROM m), ay AS (SELECT unnest(range(ry)) AS iy FROM m), az AS (SELECT unnest(range(rz)) AS iz FROM m),
v AS (SELECT (ix * ry + iy) * rz + iz AS vid, ix, iy, iz, lx + (ix + 0.5::double) * cx AS x, ly + (iy + 0.5::double) * cy AS y, lz + (iz + 0.5::double) * cz AS z
      FROM m, ax, ay, az),
pr AS (SELECT v.vid, gw.*, v.x - gw.x AS dx, v.y - gw.y AS dy, v.z - gw.z AS dz,
              pow((v.x - gw.x) / sx, 2) + pow((v.y - gw.y) / sy, 2) + pow((v.z - gw.z) / sz, 2) AS d2
       FROM v JOIN gw ON abs(v.x - gw.x) < 3 * sx AND abs(v.y - gw.y) < 3 * sy AND abs(v.z - gw.z) < 3 * sz),
sm AS (SELECT vid, sum(w * exp(-0.5::double * d2)) AS rho FROM pr WHERE d2 < 9 GROUP BY vid),
r AS (SELECT v.*, least(1e6, coalesce(sm.rho, 0)) AS rho FROM v LEFT JOIN sm USING (vid))"""


def _classes(high: float, steps: int) -> str:
    dilated = "c0" if not steps else "c1"
    return f"""
th AS (SELECT count(*) FILTER (rho > 0) AS n, count(*) FILTER (rho > 0 AND rho <= {high}::double) AS below, count(*) FILTER (rho > {high}::double) AS above,
              quantile_cont(least(rho, 1e6), 0.3) FILTER (rho > 0) AS q1, quantile_cont(least(rho, 1e6), 0.7) FILTER (rho > 0) AS q2 FROM r),
tau AS (SELECT n > 0 AND (below = 0 OR above = 0) AS adapts, q1 AS low, CASE WHEN q2 <= q1 THEN 2 * q1 ELSE q2 END AS top FROM th),
c0 AS (SELECT r.*, CASE WHEN NOT isfinite(rho) THEN 2 WHEN rho > CASE WHEN adapts THEN top ELSE {high}::double END THEN -1 WHEN rho = 0 THEN 0 WHEN rho > 0 THEN 1 ELSE 2 END::int AS node_type FROM r, tau),
c1 AS (SELECT c0.* REPLACE (CASE WHEN node_type IN (0, 1) AND EXISTS (SELECT 1 FROM c0 o WHERE o.node_type = -1 AND abs(o.ix - c0.ix) <= 1 AND abs(o.iy - c0.iy) <= 1 AND abs(o.iz - c0.iz) <= 1)
                            THEN -1 ELSE node_type END AS node_type) FROM c0),
c AS (SELECT d.* REPLACE (CASE WHEN z <= zfloor THEN -1 ELSE node_type END AS node_type) FROM {dilated} d, mm)"""


STD, DILATED, ADAPTIVE = _classes(500, 0), _classes(500, 1), _classes(0.5, 0)

AROUND = """
nb AS (SELECT a.vid, count(*) AS n27, sum(o.rho) AS s27, sum(o.rho * o.rho) AS ss27, count(*) FILTER (o.node_type = 0) AS free27, count(*) FILTER (o.node_type = -1) AS occ27
       FROM c a JOIN c o ON o.ix BETWEEN a.ix - 1 AND a.ix + 1 AND o.iy BETWEEN a.iy - 1 AND a.iy + 1 AND o.iz BETWEEN a.iz - 1 AND a.iz + 1 GROUP BY a.vid),
a0 AS (SELECT c.*, n27, free27, occ27, greatest(ss27 / n27 - pow(s27 / n27, 2), 0) AS var FROM c JOIN nb USING (vid)),
ar AS (SELECT a0.*, (a0.occ27 - (a0.node_type = -1)::int) / (a0.n27 - 1)::double AS obs_ratio,
              coalesce(xa.rho, a0.rho) - 2 * a0.rho + coalesce(xb.rho, a0.rho) AS kx, coalesce(ya.rho, a0.rho) - 2 * a0.rho + coalesce(yb.rho, a0.rho) AS ky,
              coalesce(za.rho, a0.rho) - 2 * a0.rho + coalesce(zb.rho, a0.rho) AS kz
       FROM a0 LEFT JOIN c xa ON xa.ix = a0.ix + 1 AND xa.iy = a0.iy AND xa.iz = a0.iz LEFT JOIN c xb ON xb.ix = a0.ix - 1 AND xb.iy = a0.iy AND xb.iz = a0.iz
               LEFT JOIN c ya ON ya.ix = a0.ix AND ya.iy = a0.iy + 1 AND ya.iz = a0.iz LEFT JOIN c yb ON yb.ix = a0.ix AND yb.iy = a0.iy - 1 AND yb.iz = a0.iz
               LEFT JOIN c za ON za.ix = a0.ix AND za.iy = a0.iy AND za.iz = a0.iz + 1 LEFT JOIN c zb ON zb.ix = a0.ix AND zb.iy = a0.iy AND zb.iz = a0.iz - 1)"""

NODES = """
tops AS (SELECT max(rho) AS top_rho, max(sqrt(var)) FILTER (node_type IN (0, 1)) AS top_sigma,
                max(greatest(abs(kx), abs(ky), abs(kz))) FILTER (node_type IN (0, 1)) AS top_k FROM ar),
bins AS (SELECT (least(greatest(floor((x - lx) / cx), 0), rx - 1) * ry + least(greatest(floor((y - ly) / cy), 0), ry - 1)) * rz + least(greatest(floor((z - lz) / cz), 0), rz - 1) AS vid,
                avg(op) AS alpha, avg(lum) AS lum FROM g, m GROUP BY 1),
allop AS (SELECT avg(op) AS all_alpha FROM g),
near AS (SELECT p.vid, min(sqrt(pow((p.ix - o.ix) * cx, 2) + pow((p.iy - o.iy) * cy, 2) + pow((p.iz - o.iz) * cz, 2))) AS near
         FROM ar p, ar o, m WHERE p.node_type IN (0, 1) AND o.node_type = -1 GROUP BY p.vid),
n0 AS (SELECT ar.*, row_number() OVER (ORDER BY vid) - 1 AS plan_idx, row_number() OVER (PARTITION BY node_type ORDER BY vid) - 1 AS local_id,
              (ar.x - lx) / greatest(ux - lx, 1e-6) AS f0, (ar.y - ly) / greatest(uy - ly, 1e-6) AS f1, (ar.z - lz) / greatest(uz - lz, 1e-6) AS f2,
              CASE WHEN top_k > 0 THEN kx / top_k ELSE kx END AS f3, CASE WHEN top_k > 0 THEN ky / top_k ELSE ky END AS f4, CASE WHEN top_k > 0 THEN kz / top_k ELSE kz END AS f5,
              rho / greatest(top_rho, 1e-6) AS f6, sqrt(var) / greatest(top_sigma, 1e-6) AS f7, coalesce(alpha, 0.5::double * all_alpha) AS f8,
              CASE WHEN rho > 1e-6 THEN greatest(1 - least(1.0::double, var / rho), 0) ELSE 1.0::double END AS f9,
              -(least(greatest(rho, 1e-6), 1 - 1e-6) * ln(least(greatest(rho, 1e-6), 1 - 1e-6)) + (1 - least(greatest(rho, 1e-6), 1 - 1e-6)) * ln(1 - least(greatest(rho, 1e-6), 1 - 1e-6))) / ln(2.0::double) AS f10,
              (node_type = 1)::int::double AS f11, coalesce(bins.lum, 0.5::double) AS f12, free27 / n27::double AS f13, occ27 / 26.0::double AS f14,
              coalesce(least(1.0::double, 10 * near), 1.0::double) AS f15
       FROM ar LEFT JOIN bins USING (vid) LEFT JOIN near USING (vid), tops, allop, m WHERE node_type IN (0, 1)),
n AS (SELECT *, CASE node_type WHEN 0 THEN local_id ELSE local_id + (SELECT count(*) FROM n0 WHERE node_type = 0) END AS uid FROM n0)"""

EDGES = """
e0 AS (SELECT s.plan_idx AS s_idx, t.plan_idx AS t_idx, s.local_id AS s_local, t.local_id AS t_local, s.node_type AS s_type, t.node_type AS t_type, s.uid AS s_uid, t.uid AS t_uid,
              s.f9 AS s_conf, t.f9 AS t_conf, s.obs_ratio AS s_obs, t.obs_ratio AS t_obs, diag,
              sqrt(pow((t.ix - s.ix) * cx, 2) + pow((t.iy - s.iy) * cy, 2) + pow((t.iz - s.iz) * cz, 2)) AS d
       FROM n s JOIN n t ON t.ix BETWEEN s.ix - 1 AND s.ix + 1 AND t.iy BETWEEN s.iy - 1 AND s.iy + 1 AND t.iz BETWEEN s.iz - 1 AND s.iz + 1 AND t.vid <> s.vid, mm),
e AS (SELECT *, 0.5::double * d / diag + 0.3::double * (1 - (s_conf + t_conf) / 2) + 0.2::double * s_obs AS w FROM e0),
he AS (SELECT 'free' AS src_type, 'spatial' AS rel, 'free' AS dst_type, s_local AS src, t_local AS dst, s_uid AS us, t_uid AS ut, w, d FROM e WHERE s_type = 0 AND t_type = 0
       UNION ALL SELECT 'free', 'spatial', 'frontier', s_local, t_local, s_uid, t_uid, w, d FROM e WHERE s_type = 0 AND t_type = 1
       UNION ALL SELECT 'frontier', 'spatial', 'free', t_local, s_local, t_uid, s_uid, w, d FROM e WHERE s_type = 0 AND t_type = 1
       UNION ALL SELECT 'frontier', 'connects', 'frontier', s_local, t_local, s_uid, t_uid, w, d FROM e WHERE s_type = 1 AND t_type = 1),
ue AS (SELECT us AS src, ut AS dst, w, d FROM he)"""

QUERY_ROWS = """
qs AS (SELECT * FROM (VALUES (0, -0.35::double, -0.35::double, 0.30::double, 0.35::double, 0.30::double, 0.20::double), (1, 0.35, -0.35, -0.10, -0.35, 0.35, 0.10),
       (2, -0.40, 0.00, 0.35, 0.40, 0.05, -0.20), (3, 0, 0, 0, 0.30, 0.30, 0.30), (4, -0.40, -0.40, -0.20, -0.38, -0.40, -0.20), (5, 2, 2, 2, 0, 0, 0.3))
       AS t(qid, s_x, s_y, s_z, g_x, g_y, g_z)),
pts AS (SELECT 2 * qid::bigint AS pid, s_x AS x, s_y AS y, s_z AS z FROM qs UNION ALL SELECT 2 * qid::bigint + 1, g_x, g_y, g_z FROM qs),
sn AS (SELECT pid, uid, d FROM (SELECT pid, uid, sqrt(pow(n.x - pts.x, 2) + pow(n.y - pts.y, 2) + pow(n.z - pts.z, 2)) AS d FROM n, pts)
       QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, uid) = 1),
sc AS (SELECT median(m) AS scale FROM (SELECT median(w / d) AS m FROM he WHERE d > 1e-6 GROUP BY src_type, rel, dst_type))"""

SAMPLES = """
ends AS (SELECT ue.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS len
         FROM ue JOIN n a ON a.uid = ue.src JOIN n b ON b.uid = ue.dst),
em AS (SELECT *, {m}::bigint AS m FROM ends),
es AS (SELECT *, unnest(range(m)) AS s FROM em),
ep AS (SELECT src, dst, len, m, s, ax + s / (m - 1)::double * (bx - ax) AS px, ay + s / (m - 1)::double * (by_ - ay) AS py, az + s / (m - 1)::double * (bz - az) AS pz FROM es),
wall AS (SELECT ix, iy, iz, x, y, z FROM c WHERE node_type = -1),
en AS (SELECT src, dst, any_value(len) AS len, any_value(ep.m) AS m, ep.s, min(sqrt(pow(px - wall.x, 2) + pow(py - wall.y, 2) + pow(pz - wall.z, 2))) AS near
       FROM ep CROSS JOIN mm LEFT JOIN wall ON abs(px - wall.x) < 0.25::double AND abs(py - wall.y) < 0.25::double AND abs(pz - wall.z) < 0.25::double GROUP BY src, dst, ep.s)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


B, S = _with(BASE), _with(BASE, STD)
A, N = _with(BASE, STD, AROUND), _with(BASE, STD, AROUND, NODES)
E = _with(BASE, STD, AROUND, NODES, EDGES)
P = _with(BASE, STD, AROUND, NODES, EDGES, QUERY_ROWS)

_FEATURES = {
    "position": (0, 1, 2), "curvature": (3, 4, 5), "density": (6,), "sigma": (7,), "alpha": (8,), "confidence": (9,), "info_gain": (10,),
    "frontier": (11,), "color": (12,), "free_ratio": (13,), "neighbor_occupied": (14,), "obstacle_distance": (15,),
}

_HASH = """
ho AS (SELECT *, 3 * greatest(sx, sy, sz) AS rad FROM g),
h0 AS (SELECT min(x - rad) AS ox, min(y - rad) AS oy, min(z - rad) AS oz FROM ho),
hb AS (SELECT gid, cx, cy, unnest(range(floor((z - rad - oz) / 0.3::double)::bigint, ceil((z + rad - oz) / 0.3::double)::bigint + 1)) AS cz FROM
       (SELECT *, unnest(range(floor((y - rad - oy) / 0.3::double)::bigint, ceil((y + rad - oy) / 0.3::double)::bigint + 1)) AS cy FROM
        (SELECT *, unnest(range(floor((x - rad - ox) / 0.3::double)::bigint, ceil((x + rad - ox) / 0.3::double)::bigint + 1)) AS cx FROM ho, h0))),
hp AS (SELECT gid AS pid, x + 0.02::double AS x, y + 0.02::double AS y, z + 0.02::double AS z FROM g),
hc AS (SELECT DISTINCT pid, hb.gid FROM hp, h0, hb WHERE hb.cx BETWEEN floor((hp.x - 0.05::double - ox) / 0.3::double) AND ceil((hp.x + 0.05::double - ox) / 0.3::double)
       AND hb.cy BETWEEN floor((hp.y - 0.05::double - oy) / 0.3::double) AND ceil((hp.y + 0.05::double - oy) / 0.3::double)
       AND hb.cz BETWEEN floor((hp.z - 0.05::double - oz) / 0.3::double) AND ceil((hp.z + 0.05::double - oz) / 0.3::double))"""
H = _with(BASE, _HASH)

_Quat = ", ".join(f"{_e(10 + k)} / sqrt(pow({_e(11)}, 2) + pow({_e(12)}, 2) + pow({_e(13)}, 2) + pow({_e(14)}, 2)) AS q{k}" for k in (1, 2, 3, 4))
_ROT = f"""WITH t AS (SELECT vec_id AS gid, {_Quat}, pow(0.02::double + 0.1::double * abs({_e(4)}), 2) AS a, pow(0.02::double + 0.1::double * abs({_e(5)}), 2) AS b, pow(0.02::double + 0.1::double * abs({_e(6)}), 2) AS c FROM embeddings),
u AS (SELECT gid, a, b, c, 1 - 2 * (q3*q3 + q4*q4) AS r11, 2 * (q2*q3 - q1*q4) AS r12, 2 * (q2*q4 + q1*q3) AS r13, 2 * (q2*q3 + q1*q4) AS r21, 1 - 2 * (q2*q2 + q4*q4) AS r22,
             2 * (q3*q4 - q1*q2) AS r23, 2 * (q2*q4 - q1*q3) AS r31, 2 * (q3*q4 + q1*q2) AS r32, 1 - 2 * (q2*q2 + q3*q3) AS r33 FROM t)
SELECT gid, cast(floor(a * b * c * 1e12 + 0.5::double) AS bigint) AS det,
       {_Q3.format("r11*r11/a + r12*r12/b + r13*r13/c", "ixx")}, {_Q3.format("r11*r21/a + r12*r22/b + r13*r23/c", "ixy")}, {_Q3.format("r11*r31/a + r12*r32/b + r13*r33/c", "ixz")},
       {_Q3.format("r21*r21/a + r22*r22/b + r23*r23/c", "iyy")}, {_Q3.format("r21*r31/a + r22*r32/b + r23*r33/c", "iyz")}, {_Q3.format("r31*r31/a + r32*r32/b + r33*r33/c", "izz")} FROM u"""

_GRAD = ", ".join(_Q3.format(f"coalesce(g{k}, 0)", f"g{k}") for k in "xyz")
_GSUM = ", ".join(f"sum(-wg * exp(-0.5::double * d2) * d{k} / (s{k} * s{k})) AS g{k}" for k in "xyz")

ORACLE_SQL: dict[str, str] = {
    "bounds_filter_scene": B + f"SELECT gid, {qs('x', 'y', 'z')} FROM g WHERE greatest(abs(x), abs(y), abs(z)) <= 0.2::double",
    "scene_bounds": B + f"SELECT {q('lx', 'min_x')}, {q('ly', 'min_y')}, {q('lz', 'min_z')}, {q('ux', 'max_x')}, {q('uy', 'max_y')}, {q('uz', 'max_z')}, rx, ry, rz FROM m",
    "grid_centers": B + f"SELECT vid, ix, iy, iz, {qs('x', 'y', 'z')} FROM v",
    "covariance_inverse": _ROT,
    "density_field": B + f"SELECT vid, {q('rho')} FROM r",
    "density_gradient": B + f"SELECT vid, {_GRAD} FROM v LEFT JOIN (SELECT vid, {_GSUM} FROM pr WHERE d2 < 9 GROUP BY vid) USING (vid)",
    "density_at_points": B + f""", pp AS (SELECT gid AS pid, x + 0.01::double AS x, y + 0.01::double AS y, z + 0.01::double AS z FROM g),
        pq AS (SELECT pid, gw.*, pp.x - gw.x AS dx, pp.y - gw.y AS dy, pp.z - gw.z AS dz, pow((pp.x - gw.x) / sx, 2) + pow((pp.y - gw.y) / sy, 2) + pow((pp.z - gw.z) / sz, 2) AS d2 FROM pp, gw)
        SELECT pid, {q('least(1e6, coalesce(rho, 0))', 'rho')}, {_GRAD} FROM pp LEFT JOIN (SELECT pid, sum(w * exp(-0.5::double * d2)) AS rho, {_GSUM} FROM pq WHERE d2 < 9 GROUP BY pid) USING (pid)""",
    "classify_fixed": B + "SELECT vid, CASE WHEN NOT isfinite(rho) THEN 2 WHEN rho > 500 THEN -1 WHEN rho = 0 THEN 0 WHEN rho > 0 THEN 1 ELSE 2 END::int AS node_type FROM r",
    "adaptive_thresholds": _with(BASE, ADAPTIVE) + f"SELECT adapts, {q('low')}, {q('top', 'high')} FROM tau",
    "classify_adaptive": _with(BASE, ADAPTIVE) + "SELECT vid, node_type FROM c0",
    "dilate_occupied": S + "SELECT vid, node_type FROM c1",
    "floor_filter": S + "SELECT vid, node_type FROM c",
    "planning_mask": S + "SELECT vid, node_type FROM c WHERE node_type IN (0, 1)",
    "binary_grid": S + "SELECT vid, node_type IN (-1, 2) AS non_navigable FROM c0",
    "class_counts": S + "SELECT node_type, count(*) AS n FROM c GROUP BY node_type",
    "class_counts_dilated": _with(BASE, DILATED) + "SELECT node_type, count(*) AS n FROM c GROUP BY node_type",
    "class_counts_adaptive": _with(BASE, ADAPTIVE) + "SELECT node_type, count(*) AS n FROM c GROUP BY node_type",
    "uncertainty_grid": A + f"SELECT vid, {q('CASE WHEN rho <= 0 THEN 0 ELSE least(var / greatest(rho, 1e-6), 1.0::double) END', 'uncertainty')} FROM a0",
    "obstacle_ratio": A + f"SELECT vid, {q('obs_ratio')} FROM ar",
    **{f"feat_{k}": N + f"SELECT vid, plan_idx, {qs(*[f'f{i}' for i in v])} FROM n" for k, v in _FEATURES.items()},
    "node_features": N + f"SELECT vid, plan_idx, local_id, uid, node_type, {qs(*[f'f{i}' for i in range(16)])} FROM n",
    "neutral_features": N + "SELECT plan_idx, 1000000::bigint AS f9, 0::bigint AS f10, 0::bigint AS f11 FROM n",
    "type_local_ids": N + "SELECT plan_idx, node_type, local_id, uid FROM n",
    "legacy_view": N + f"SELECT plan_idx, {q('x', 'f0')}, {q('y', 'f1')}, {q('z', 'f2')}, {q('f6')} FROM n",
    "offset_table": B + f"""SELECT di, dj, dk, {q('sqrt(pow(di * cx, 2) + pow(dj * cy, 2) + pow(dk * cz, 2))', 'd')} FROM m, (SELECT unnest(range(-1, 2)) AS di), (SELECT unnest(range(-1, 2)) AS dj),
        (SELECT unnest(range(-1, 2)) AS dk) WHERE di <> 0 OR dj <> 0 OR dk <> 0""",
    **{f"edges_{k}": E + f"SELECT s_idx AS src, t_idx AS dst, {q('w')} FROM e WHERE s_type = {a} AND t_type = {b}" for k, a, b in (("free_free", 0, 0), ("free_frontier", 0, 1), ("frontier_frontier", 1, 1))},
    "edges_knn": N + f""", kn AS (SELECT s.plan_idx AS src, t.plan_idx AS dst, s.f9 AS s_conf, t.f9 AS t_conf, s.obs_ratio AS s_obs, t.obs_ratio AS t_obs, diag,
              sqrt(pow((t.ix - s.ix) * cx, 2) + pow((t.iy - s.iy) * cy, 2) + pow((t.iz - s.iz) * cz, 2)) AS d FROM n s, n t, mm WHERE s.vid <> t.vid),
        kr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM kn WHERE d < 3 * diag)
        SELECT src, dst, rank, {q('0.5::double * d / diag + 0.3::double * (1 - (s_conf + t_conf) / 2) + 0.2::double * ((s_obs + t_obs) / 2)', 'w')} FROM kr WHERE rank <= 6""",
    "hetero_edges": E + f"SELECT src_type, rel, dst_type, src, dst, {q('w')} FROM he",
    "unified_edges": E + f"SELECT src, dst, {q('w')} FROM ue",
    "adjacency": E + f"SELECT src, dst, {q('w')}, {q('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))', 'len')}, {q('abs(a.z - b.z)', 'dz')} FROM ue JOIN n a ON a.uid = src JOIN n b ON b.uid = dst",
    "graph_stats": E + """SELECT CASE node_type WHEN 0 THEN 'nodes_free' ELSE 'nodes_frontier' END AS name, count(*) AS n FROM n GROUP BY node_type
        UNION ALL SELECT 'edges_' || src_type || '_' || rel || '_' || dst_type, count(*) FROM he GROUP BY ALL""",
    "hash_build": H + "SELECT cx, cy, cz, gid FROM hb",
    "hash_candidates": H + "SELECT pid, gid FROM hc",
    "hash_knn": H + f"""SELECT pid, rank, gid, {q('d')} FROM (SELECT pid, hc.gid, d, row_number() OVER (PARTITION BY pid ORDER BY d, hc.gid) AS rank FROM
        (SELECT hc.pid, hc.gid, sqrt(pow(hp.x - g.x, 2) + pow(hp.y - g.y, 2) + pow(hp.z - g.z, 2)) AS d FROM hc JOIN hp USING (pid) JOIN g ON g.gid = hc.gid) hc) WHERE rank <= 5""",
    "hash_stats": H + """SELECT count(*) AS n_cells, cast(sum(n) AS bigint) AS n_entries, max(n) AS max_per_cell, max(cx) + 1 AS dim_x, max(cy) + 1 AS dim_y, max(cz) + 1 AS dim_z
        FROM (SELECT cx, cy, cz, count(*) AS n FROM hb GROUP BY ALL)""",
    "snap_nodes": P + f"SELECT pid, uid, {q('d')}, CASE WHEN d > 0.35::double THEN 'fail' WHEN d > 0.15::double THEN 'warn' ELSE 'ok' END AS status FROM sn",
    "batch_snap_anchors": P + "SELECT DISTINCT uid FROM sn WHERE d <= 0.35::double",
    "cost_scale": P + f"SELECT {q('scale')} FROM sc",
    **{name: P + f"SELECT qid::bigint AS qid, uid, {q('greatest(0, sqrt(pow(x - g_x, 2) + pow(y - g_y, 2) + pow(z - g_z, 2)) * scale' + extra + ')', 'h')} FROM n, qs, sc"
       for name, extra in (("heuristic_unc", " + (1 - f9) + 0.5::double * f11"), ("heuristic_geo", ""))},
    "heuristic_line": P + f""", ql AS (SELECT *, pow(g_x - s_x, 2) + pow(g_y - s_y, 2) + pow(g_z - s_z, 2) AS l2 FROM qs),
        tt AS (SELECT *, least(greatest(((x - s_x) * (g_x - s_x) + (y - s_y) * (g_y - s_y) + (z - s_z) * (g_z - s_z)) / l2, 0), 1) AS t FROM n, ql, sc)
        SELECT qid::bigint AS qid, uid, {q('greatest(0, sqrt(pow(x - g_x, 2) + pow(y - g_y, 2) + pow(z - g_z, 2)) * scale + 0.7::double * sqrt(pow(x - s_x - t * (g_x - s_x), 2) + pow(y - s_y - t * (g_y - s_y), 2) + pow(z - s_z - t * (g_z - s_z), 2)) / greatest(sqrt(l2), 1e-3) + (1 - f9) + 0.5::double * f11)', 'h')} FROM tt""",
    "edge_obstacle_penalty": _with(BASE, STD, AROUND, NODES, EDGES, SAMPLES.format(m="least(32, greatest(4, ceil(len / 0.01::double) + 1))"))
    + f"SELECT src, dst, {q('3.0::double * sum(coalesce(exp(-pow(near / 0.04::double, 2)), 0)) / any_value(m) * (0.5::double + 0.5::double * least(1.0::double, any_value(len) / 0.04::double))', 'penalty')} FROM en GROUP BY src, dst",
    "segment_clear": _with(BASE, STD, AROUND, NODES, EDGES, SAMPLES.format(m="least(64, greatest(8, ceil(len / 0.01::double)))"))
    + "SELECT src, dst, coalesce(min(near), 1) >= 0.02::double * 1.05::double AS clear FROM en GROUP BY src, dst",
    "shortest_costs": P.replace("WITH ", "WITH RECURSIVE ", 1) + f""", em_ AS MATERIALIZED (SELECT src, dst, w FROM ue), gl AS MATERIALIZED (SELECT DISTINCT uid AS goal FROM sn WHERE pid % 2 = 1),
        sp(goal, node, cost) USING KEY (goal, node) AS (SELECT goal, goal, 0.0::double FROM gl UNION
          (SELECT sp.goal, em_.dst, min(sp.cost + em_.w) FROM sp JOIN em_ ON em_.src = sp.node LEFT JOIN recurring.sp k ON k.goal = sp.goal AND k.node = em_.dst
           WHERE k.cost IS NULL OR sp.cost + em_.w < k.cost GROUP BY sp.goal, em_.dst))
        SELECT goal, node, {q('cost')} FROM sp""",
    "goal_cost_cache": P + "SELECT DISTINCT uid AS goal FROM sn WHERE pid % 2 = 1 AND uid NOT IN (SELECT uid FROM sn WHERE pid % 2 = 1 AND pid < 6)",
}

_PATHS = """
p0 AS (SELECT gid // 24 AS qid, row_number() OVER (PARTITION BY gid // 24 ORDER BY gid) - 1 AS seq, x, y, z, op AS f9 FROM g),
pt AS (SELECT *, seq % 2 AS node_type FROM p0),
cnt AS (SELECT qid, count(*) AS k FROM pt GROUP BY qid),
sgs AS (SELECT a.qid, a.seq, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS len FROM pt a JOIN pt b ON a.qid = b.qid AND b.seq = a.seq + 1),
sct AS (SELECT DISTINCT p.qid, p.seq, least(s.seq // 5, 5) AS section, p.x, p.y, p.z, p.f9, p.node_type FROM pt p JOIN sgs s ON s.qid = p.qid AND p.seq IN (s.seq, s.seq + 1)),
wd AS (SELECT qid, section, least(greatest(avg(CASE node_type WHEN 1 THEN 0.3::double + 0.4::double * f9 ELSE 0.5::double + 0.5::double * f9 END), 0), 1) AS width FROM sct GROUP BY qid, section)"""
_WALLS = """
wl AS (SELECT x, y, z FROM c WHERE node_type = -1),
st AS (SELECT sgs.*, wl.*, pow(len, 2) AS l2, (x - ax) * (bx - ax) + (y - ay) * (by_ - ay) + (z - az) * (bz - az) AS dot FROM sgs, wl),
su AS (SELECT *, CASE WHEN l2 < 1e-12 THEN 0 ELSE least(greatest(dot / l2, 0), 1) END AS t FROM st),
cl AS (SELECT qid, seq, min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2) + pow(z - az - t * (bz - az), 2))) AS clearance FROM su GROUP BY qid, seq),
mt AS (SELECT pt.qid, count(*) AS n_points, avg(pow(p.x - 2 * pt.x + n.x, 2) + pow(p.y - 2 * pt.y + n.y, 2) + pow(p.z - 2 * pt.z + n.z, 2)) AS smoothness,
              (SELECT sum(len) FROM sgs WHERE sgs.qid = pt.qid) AS path_length,
              (SELECT min(sqrt(pow(o.x - wl.x, 2) + pow(o.y - wl.y, 2) + pow(o.z - wl.z, 2))) FROM pt o, wl WHERE o.qid = pt.qid) AS min_collision_dist
       FROM pt LEFT JOIN pt p ON p.qid = pt.qid AND p.seq = pt.seq - 1 LEFT JOIN pt n ON n.qid = pt.qid AND n.seq = pt.seq + 1 GROUP BY pt.qid)"""
_G, _GW = _with(BASE, _PATHS), _with(BASE, STD, _PATHS, _WALLS)

_TUBE = """, ed AS (SELECT qid, section, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_min(z, seq) AS az, arg_max(x, seq) AS bx, arg_max(y, seq) AS by_, arg_max(z, seq) AS bz FROM sct GROUP BY qid, section),
        e1 AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2)) AS len FROM ed),
        e2 AS (SELECT qid, section, (bx - ax) / (len + 1e-8) AS d0, (by_ - ay) / (len + 1e-8) AS d1, (bz - az) / (len + 1e-8) AS d2 FROM e1),
        e3 AS (SELECT *, CASE WHEN abs(d0) > 0.9::double THEN 0 ELSE 1 END::double AS h0, CASE WHEN abs(d0) > 0.9::double THEN 1 ELSE 0 END::double AS h1 FROM e2),
        e4 AS (SELECT *, d1 * 0 - d2 * h1 AS c0, d2 * h0 - d0 * 0 AS c1, d0 * h1 - d1 * h0 AS c2 FROM e3),
        e5 AS (SELECT *, sqrt(c0*c0 + c1*c1 + c2*c2) + 1e-8 AS cn FROM e4),
        e6 AS (SELECT *, c0 / cn AS u0, c1 / cn AS u1, c2 / cn AS u2 FROM e5),
        e7 AS (SELECT *, d1 * u2 - d2 * u1 AS v0, d2 * u0 - d0 * u2 AS v1, d0 * u1 - d1 * u0 AS v2 FROM e6),
        pj AS (SELECT e7.*, wd.width, x*d0 + y*d1 + z*d2 AS pd, x*u0 + y*u1 + z*u2 AS pu, x*v0 + y*v1 + z*v2 AS pv FROM sct JOIN e7 USING (qid, section) JOIN wd USING (qid, section)),
        mx AS (SELECT qid, section, any_value(d0) AS d0, any_value(d1) AS d1, any_value(d2) AS d2, 0.02::double + 1.5::double * 0.08::double * (1 + 0.8::double * (1 - any_value(width))) AS pad,
                      min(pd) AS nd, max(pd) AS xd, min(pu) AS nu, max(pu) AS xu, min(pv) AS nv, max(pv) AS xv FROM pj GROUP BY qid, section),
        lt AS (SELECT *, greatest(greatest(abs(nu), abs(xu)) + pad, 0.05::double) AS lu, greatest(greatest(abs(nv), abs(xv)) + pad, 0.05::double) AS lv FROM mx)"""

#: Rows of A and b: the three axes, then their opposites.
_FACES = ", l2 AS (SELECT lt.*, e7.u0, e7.u1, e7.u2, e7.v0, e7.v1, e7.v2, wd.width FROM lt JOIN e7 USING (qid, section) JOIN wd USING (qid, section)), fc AS (" + " UNION ALL ".join(
    f"SELECT qid, section, {face}::bigint AS face, {sign}{a}0 AS a0, {sign}{a}1 AS a1, {sign}{a}2 AS a2, {b} AS b, width FROM l2"
    for face, (a, sign, b) in enumerate(
        [("d", "", "xd + pad"), ("u", "", "greatest(xu + pad, lu)"), ("v", "", "greatest(xv + pad, lv)"), ("d", "-", "-(nd - pad)"), ("u", "-", "-least(nu - pad, -lu)"), ("v", "-", "-least(nv - pad, -lv)")]
    )
) + ")"

_COSTS = """
co AS (SELECT gn.uid AS goal, n.uid AS node, n.*, sqrt(pow(n.x - gn.x, 2) + pow(n.y - gn.y, 2) + pow(n.z - gn.z, 2)) AS far FROM n, n gn WHERE gn.uid IN (SELECT uid FROM sn WHERE pid % 2 = 1)),
cc AS (SELECT *, 3 * far + f6 AS cost, 2 * far AS geo, 2.7::double * far + 0.1::double * f13 AS pred FROM co),
tg AS (SELECT goal, node, cost, geo, pred, cost + 3 * (1 - least(greatest(f15, 0), 1)) + 1.5::double * greatest(f14, 0) + 1.6::double * sqrt(f3*f3 + f4*f4 + f5*f5) AS target FROM cc),
rs AS (SELECT goal, greatest(avg(abs(target)), 1) AS scale, max(target) AS top, count(*) AS n FROM tg GROUP BY goal),
pw AS (SELECT goal, avg(CASE WHEN gap < 1 THEN 0.5::double * gap * gap ELSE gap - 0.5::double END) AS mse, 0.1::double * avg(greatest(pred - target, 0)) AS over
       FROM (SELECT *, abs(pred - target) / scale AS gap FROM tg JOIN rs USING (goal)) GROUP BY goal),
pl AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY node) - 1 AS place FROM tg),
pk AS (SELECT goal, scale, n, unnest(range(least(2048, 4 * n))) AS k FROM rs WHERE n >= 8),
rk AS (SELECT pk.goal, avg(greatest(0.05::double - (b.pred - a.pred) / scale * sign(b.target - a.target), 0)) AS rank FROM pk
       JOIN pl a ON a.goal = pk.goal AND a.place = (k * 7919) % n JOIN pl b ON b.goal = pk.goal AND b.place = (k * 104729 + 13) % n
       WHERE a.place <> b.place AND abs(b.target - a.target) > 0.005::double * scale GROUP BY pk.goal)"""
_C = _CE = _with(BASE, STD, AROUND, NODES, EDGES, QUERY_ROWS, _COSTS)


def _mono(where: str) -> str:
    return f""", ts AS (SELECT * FROM tg WHERE {where}), tr AS (SELECT goal, greatest(avg(abs(target)), 1) AS scale FROM ts GROUP BY goal),
        mo AS (SELECT a.goal, avg(greatest(0.02::double * scale - (b.pred - a.pred) * sign(b.target - a.target), 0) / scale) AS mono
               FROM ue JOIN ts a ON a.node = ue.src JOIN ts b ON b.node = ue.dst AND b.goal = a.goal JOIN tr ON tr.goal = a.goal WHERE abs(b.target - a.target) > 1e-4 GROUP BY a.goal)"""


_STEP = ", ".join(f"0.28::double * (0.5::double * (p.{k} + n.{k}) - o.{k}) + 0.1::double * (p.{k} - 2 * o.{k} + n.{k}) AS d{k}" for k in "xyz")
_MOVED = ", ".join(f"CASE WHEN px IS NULL OR nx IS NULL THEN {k} ELSE {k} + d{k} * CASE WHEN size > 0.01::double THEN 0.01::double / greatest(size, 1e-8) ELSE 1 END END AS {k}" for k in "xyz")

ORACLE_SQL |= {
    "path_profile": _G + f"""SELECT a.qid, a.seq, {q('1.5::double * (abs(b.z - c.z) + abs(a.z - b.z))', 'slope')}, {q('1.8::double * abs(a.z - 2 * b.z + c.z)', 'curvature')}
        FROM pt a JOIN pt b ON b.qid = a.qid AND b.seq = a.seq - 1 JOIN pt c ON c.qid = a.qid AND c.seq = a.seq - 2""",
    "path_sections": _G + "SELECT qid, seq, section FROM sct",
    "corridor_width": _G + f"SELECT qid, section, {q('width')} FROM wd",
    "corridor_tubes": _G + _TUBE + f"""SELECT qid, section, {qs('d0', 'd1', 'd2')}, {q('nd - pad', 'lo_d')}, {q('xd + pad', 'hi_d')}, {q('least(nu - pad, -lu)', 'lo_u')}, {q('greatest(xu + pad, lu)', 'hi_u')},
        {q('least(nv - pad, -lv)', 'lo_v')}, {q('greatest(xv + pad, lv)', 'hi_v')} FROM lt""",
    "corridor_half_spaces": _G + _TUBE + _FACES + f"SELECT qid, section, face, {qs('a0', 'a1', 'a2', 'b')} FROM fc",
    "corridor_shrink": _G + _TUBE + _FACES + f"""SELECT qid, section, face, {q('a0 / nm', 'a0')}, {q('a1 / nm', 'a1')}, {q('a2 / nm', 'a2')}, {q('b / nm - 0.02::double - (1 - width) * 0.05::double', 'b')}
        FROM (SELECT *, greatest(sqrt(a0*a0 + a1*a1 + a2*a2), 1e-8) AS nm FROM fc)""",
    "segment_clearance": _GW + f"SELECT qid, seq, {q('clearance')} FROM cl",
    "trajectory_collision": _GW + "SELECT qid, bool_or(clearance < 0.02::double) AS collides FROM cl GROUP BY qid",
    "smooth_sweep": _G + f""", sw AS (SELECT o.qid, o.seq, o.x, o.y, o.z, p.x AS px, n.x AS nx, {_STEP} FROM pt o LEFT JOIN pt p ON p.qid = o.qid AND p.seq = o.seq - 1 LEFT JOIN pt n ON n.qid = o.qid AND n.seq = o.seq + 1),
        sz AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS size FROM sw), mv AS (SELECT qid, seq, {_MOVED} FROM sz) SELECT qid, seq, {qs('x', 'y', 'z')} FROM mv""",
    "resample_polyline": _G + f""", ac AS (SELECT *, sum(len) OVER (PARTITION BY qid ORDER BY seq) AS upto, sum(len) OVER (PARTITION BY qid) AS total FROM sgs),
        tn AS (SELECT DISTINCT qid, total, greatest(2, ceil(total / 0.05::double)::bigint + 1) AS n FROM ac), tk AS (SELECT qid, total, n, unnest(range(n)) AS k FROM tn),
        hit AS (SELECT tk.qid, tk.k, arg_min(ac, ac.seq) AS s, any_value(k * (tk.total / (n - 1))) AS goal_at FROM tk JOIN ac ON ac.qid = tk.qid AND (ac.upto >= k * (tk.total / (n - 1)) - 1e-12) GROUP BY tk.qid, tk.k)
        SELECT qid, k AS seq, {', '.join(q(f's.{a} + least(greatest((goal_at - (s.upto - s.len)) / s.len, 0), 1) * (s.{b} - s.{a})', k) for a, b, k in (('ax', 'bx', 'x'), ('ay', 'by_', 'y'), ('az', 'bz', 'z')))} FROM hit""",
    "trajectory_metrics": _GW + f"SELECT qid, n_points, {qs('path_length', 'min_collision_dist', 'smoothness')} FROM mt",
    "trial_summary": _GW + f"""SELECT 'own' AS planner, count(*) AS n, 1000000::bigint AS success_rate, {q('avg(path_length)', 'mean_path_length')}, {q('stddev_pop(path_length)', 'std_path_length')},
        {q('avg(min_collision_dist)', 'mean_min_collision_dist')}, {q('avg(smoothness)', 'mean_smoothness')} FROM mt""",
    "segment_softmax": E + f""", sx AS (SELECT src, dst, exp(least(greatest(5 * w - max(5 * w) OVER (PARTITION BY dst), -60), 60)) AS ex FROM ue)
        SELECT src, dst, {q('ex / (sum(ex) OVER (PARTITION BY dst) + 1e-9)', 'alpha')} FROM sx""",
    "random_pairs": """WITH r AS (SELECT i AS pair, (i * 1103515245 + 42 * 12345 + 12345) % 2147483648 % 1000 AS src, (i * 69069 + 42 * 7 + 1) % 2147483648 % 999 + 1 AS step FROM range(100) t(i))
        SELECT pair, src, (src + step) % 1000 AS dst FROM r""",
    "train_samples": _C + f""", en AS (SELECT goal, min(cost) AS lo, max(cost) AS hi, count(*) AS n, arg_min(node, cost) AS best FROM cc GROUP BY goal),
        fl AS (SELECT cc.goal, node, cost, n, cost - lo <= 0.2::double * (hi - lo) AS band, cost - lo <= 0.01::double * greatest(hi - lo, 1) AS hard, node = best AS special FROM cc JOIN en USING (goal)),
        lf AS (SELECT goal, least(700, any_value(n)) - count(*) FILTER (band) - count(*) FILTER (hard) - 1 AS lft FROM fl GROUP BY goal),
        bg AS (SELECT goal, node, cost, row_number() OVER (PARTITION BY goal ORDER BY md5(goal || '|' || node), node) AS place FROM fl WHERE NOT (band OR hard OR special))
        SELECT goal, node, {q('cost')} FROM fl WHERE band OR hard OR special UNION ALL SELECT bg.goal, node, {q('cost')} FROM bg JOIN lf ON lf.goal = bg.goal WHERE place <= greatest(lft, 16)""",
    "composite_target": _C + f"SELECT goal, node, {q('target')} FROM tg",
    "pointwise_loss": _C + f"SELECT goal, {qs('mse', 'over')} FROM pw",
    "ranking_loss": _C + f"SELECT goal, {q('coalesce(rank, 0)', 'rank')} FROM rs LEFT JOIN rk USING (goal)",
    "monotonic_loss": _CE + _mono("true") + f"SELECT goal, {q('mono')} FROM mo",
    "simple_loss": _C + f"SELECT {q('avg(pow(pred - target, 2)) + 0.5::double * avg(greatest(pred - target, 0))', 'loss')} FROM tg",
    "total_loss": _CE + _mono("true") + f""", en AS (SELECT goal, max(pred) AS sh, min(pred) AS gh FROM tg GROUP BY goal),
        bi AS (SELECT goal, greatest(gh - 0.05::double * scale, 0) + greatest(abs(top - sh) - 0.1::double * greatest(top, 1), 0) AS bias FROM rs JOIN en USING (goal))
        SELECT goal, {q('bias')}, {q('mse + over + 0.2::double * rank + 0.1::double * mono + 0.05::double * bias', 'loss')} FROM pw JOIN rk USING (goal) JOIN mo USING (goal) JOIN bi USING (goal)""",
    "read_pairs": """SELECT * FROM (VALUES (0, 0.0::double, 1.0::double, 2.0::double, 3.0::double, 4.0::double, 5.0::double), (1, 1, 1, 1, 2, 2, 2)) t(pair, s_x, s_y, s_z, g_x, g_y, g_z)""",
}

_ENDS = QUERY_ROWS.split(",\npts AS")[0]
_JOINED = """
eq AS (SELECT c.qid, s_x, s_y, s_z, g_x, g_y, g_z FROM cnt c JOIN qs ON qs.qid = c.qid % 6),
al AS (SELECT qid, -1 AS seq, s_x AS x, s_y AS y, s_z AS z FROM eq UNION ALL SELECT qid, seq, x, y, z FROM pt UNION ALL SELECT qid, 1000000, g_x, g_y, g_z FROM eq),
rn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seq) AS k FROM al),
joined AS (SELECT a.qid, a.k AS seq, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS len
           FROM rn a JOIN rn b ON a.qid = b.qid AND b.k = a.k + 1)"""

ORACLE_SQL |= {
    "fallback_smooth": _with(BASE, _PATHS, _ENDS, _JOINED) + ORACLE_SQL["resample_polyline"][len(_G) :].replace("FROM sgs", "FROM joined"),
    "finite_points": B + f"SELECT gid, {qs('x', 'y', 'z')} FROM g WHERE gid % 7 > 2",
    "feature_distance": P + f"SELECT qid::bigint AS qid, uid, {q('10 * sqrt(pow(f0 - g_x, 2) + pow(f1 - g_y, 2) + pow(f2 - g_z, 2))', 'h')} FROM n, qs",
    "train_tensors": N + f"SELECT uid, {qs('x', 'y', 'z')}, k, {q('fs[k + 1]', 'value')} FROM (SELECT uid, x, y, z, [{', '.join(f'f{i}::double' for i in range(16))}] AS fs, unnest(range(16)) AS k FROM n)",
}
