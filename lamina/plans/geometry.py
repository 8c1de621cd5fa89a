"""Queries on frames, rays, triangles, requests and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.derive import labels, predictions, query_points, samples, surface_points, voxels, with_sql
from lamina.operators import axis as ax
from lamina.operators import geometry as ge
from lamina.operators import iterate as it
from lamina.operators import quality as qu
from lamina.operators import sampling as sa
from lamina.operators import surface as su
from lamina.operators import volume as vo
from lamina.plans.points import _GRID50, AXIS, _axis, _scaled, _sizes, _sqls
from lamina.plans.surfaces import QUAD, WIDE, _wide
from lamina.session import table

FRAME = ge.plane_frame((1.0, 2.0, 3.0))
LO, HI = (4.0, 6.0, 8.0), (20.0, 22.0, 24.0)
DIR = (0.3, -0.5, 0.8)
DIRECTION = list(DIR)
_AX = "xyz"


def _d(u, v):
    return [f"({v}{c} - {u}{c})" for c in _AX]


def _dot(a, b):
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def _cross(a, b):
    return [f"({a[k]} * {b[m]} - {a[m]} * {b[k]})" for k, m in ((1, 2), (2, 0), (0, 1))]


def _tri(p, a, b, c):
    """Squared distance of a point to a triangle, in SQL: least over sides, and the plane where the foot is inside."""
    def side(u, v):
        e, d = _d(u, v), _d(u, p)
        t = f"least(1, greatest(0, CASE WHEN {_dot(e, e)} > 0 THEN {_dot(d, e)} / {_dot(e, e)} ELSE 0 END))"
        return "(" + " + ".join(f"pow({d[k]} - {t} * {e[k]}, 2)" for k in range(3)) + ")"
    n = _cross(_d(a, b), _d(a, c))
    ins = " AND ".join(f"{_dot(_cross(_d(u, v), _d(u, p)), n)} >= 0" for u, v in ((a, b), (b, c), (c, a)))
    return f"CASE WHEN {_dot(n, n)} > 1e-18 AND {ins} THEN pow({_dot(_d(a, p), n)}, 2) / {_dot(n, n)} ELSE least({side(a, b)}, {side(b, c)}, {side(c, a)}) END"


def _lv(v):
    return f"CAST(least(greatest(floor(log2(greatest({v} * 0.05e0 / 1, 1))), 0), 4) AS INT)"


def _bricks(s, d):
    return voxels(s, d).select(*(F.expr(f"cast({c} div 2 as int)").alias("b" + c) for c in "zyx")).distinct()


def _stored_maps(s, d):
    """Maps stored when the surfaces with odd numbers still had all their points."""
    k, p = F.col("p_partkey"), table(s, d, "part")
    valid = (F.col("p_size") % 17 != 0) | (F.expr("p_partkey div 500") % 2 == 1)
    return p.groupBy(F.expr("cast(p_partkey div 500 as int)").alias("seg_id")).agg((F.max(k % 50) + 1).cast("int").alias("gw"), (F.max(F.expr("p_partkey div 50") % 10) + 1).cast("int").alias("gh"), F.count_if(valid).alias("nvalid"))


BRICKS = "bk AS (SELECT DISTINCT CAST(z // 2 AS INT) AS bz, CAST(y // 2 AS INT) AS by_, CAST(x // 2 AS INT) AS bx FROM voxel)"

QUERIES = {
    "g17_plane_frame": (
        lambda s, d: ge.in_frame(query_points(s, d), (3.0, 4.0, 5.0), FRAME).select("pt_id", *(_scaled(c) for c in "uvw")),
        with_sql("qp", "SELECT pt_id, " + ", ".join(_sqls(" + ".join(f"({c} - {o}) * {a!r}e0" if "e" not in repr(a) else f"({c} - {o}) * {a!r}" for c, o, a in zip(_AX, (3, 4, 5), e, strict=True)), n) for e, n in zip(FRAME, "uvw", strict=True)) + " FROM qp"),
    ),
    "r5_ray_box": (
        lambda s, d: query_points(s, d).select("pt_id", *(e.alias(n) for e, n in zip(ge.ray_box([F.col(c) for c in _AX], DIRECTION, LO, HI), ("t0", "t1"), strict=True))).where("t0 <= t1").select("pt_id", _scaled("t0"), _scaled("t1")),
        with_sql(
            "qp",
            ", r AS (SELECT pt_id, greatest(0, " + ", ".join(f"least(({a} - {c}) / {e}e0, ({b} - {c}) / {e}e0)" for c, e, a, b in zip(_AX, DIR, LO, HI, strict=True)) + ") AS t0, least(" + ", ".join(f"greatest(({a} - {c}) / {e}e0, ({b} - {c}) / {e}e0)" for c, e, a, b in zip(_AX, DIR, LO, HI, strict=True)) + f") AS t1 FROM qp) SELECT pt_id, {_sqls('t0', 't0')}, {_sqls('t1', 't1')} FROM r WHERE t0 <= t1",
        ),
    ),
    "r7_crop_box": (lambda s, d: vo.box(voxels(s, d), (0, 0, 0), (16, 32, 8)), with_sql("voxel", "SELECT * FROM voxel WHERE z < 16 AND x < 8")),
    "j1_point_brick_join": (
        lambda s, d: query_points(s, d).select("pt_id", *(F.floor(F.col(c) / 8).cast("int").alias(c) for c in _AX)).join(vo.brick_summary(voxels(s, d)), ["z", "y", "x"], "left").select("pt_id", F.coalesce("vmax", F.lit(0)).alias("vmax"), F.coalesce("n_nonzero", F.lit(0)).alias("n_nonzero")),
        with_sql("qp voxel", ", b AS (SELECT z // 8 AS z, y // 8 AS y, x // 8 AS x, max(v) AS vmax, count(*) FILTER (v > 0) AS n FROM voxel GROUP BY 1, 2, 3) SELECT pt_id, coalesce(vmax, 0) AS vmax, coalesce(n, 0) AS n_nonzero FROM qp LEFT JOIN b ON b.z = floor(qp.z / 8) AND b.y = floor(qp.y / 8) AND b.x = floor(qp.x / 8)"),
    ),
    "j5_nearest_surface": (
        lambda s, d: ge.nearest_surface(_wide(s, d), su.quads(surface_points(s, d)), 60.0).select("pt_id", _scaled("d2", 3)),
        with_sql(
            "sp qp",
            f", {WIDE}, {QUAD}, c AS (SELECT pt_id, w.x AS wx, w.y AS wy, w.z AS wz, quad.* FROM wide w JOIN quad ON "
            + " AND ".join(f"w.{c} BETWEEN least(p{c}, q{c}, r{c}, s{c}) - 60 AND greatest(p{c}, q{c}, r{c}, s{c}) + 60" for c in _AX)
            + f"), m AS (SELECT pt_id, min(least({_tri('w', 'p', 'q', 'r')}, {_tri('w', 's', 'r', 'q')})) AS d2 FROM c GROUP BY 1) SELECT pt_id, {_sqls('d2', 'd2', 3)} FROM m WHERE d2 <= 3600",
        ),
    ),
    "j10_nearest_cell": (
        lambda s, d: (lambda sp: qu.nearest_cell(sp, sp.where("z % 11 = 0")))(surface_points(s, d)),
        with_sql("sp", ", c AS (SELECT a.seg_id, a.j AS aj, a.i AS ai, CAST((b.j - a.j) * (b.j - a.j) + (b.i - a.i) * (b.i - a.i) AS INT) AS d2, b.j, b.i FROM sp a JOIN sp b ON b.seg_id = a.seg_id AND abs(b.j - a.j) <= 3 AND abs(b.i - a.i) <= 3 WHERE b.z % 11 = 0) SELECT seg_id, aj, ai, d2, j, i FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, aj, ai ORDER BY d2, j, i) AS n FROM c) WHERE n = 1"),
    ),
    "j12_segment_triangle": (
        lambda s, d: su.quads(surface_points(s, d)).select("seg_id", "j", "i", ge.segment_hits_triangle([F.col("p00.x") + 4, F.col("p00.y") + 5, F.lit(60.0)], [F.col("p00.x") + 9, F.col("p00.y") + 6, F.lit(120.0)], *([F.col(f"{p}.{c}") for c in _AX] for p in ("p00", "p10", "p01"))).alias("hit")),
        with_sql(
            "sp",
            f", {QUAD}, g AS (SELECT *, px + 4 AS ax, py + 5 AS ay, 60e0 AS az, px + 9 AS bx, py + 6 AS by_, 120e0 AS bz FROM quad), h AS (SELECT *, by_ AS dy0 FROM g)"
            + " SELECT seg_id, j, i, abs(det) > 1e-12 AND u >= 0 AND v >= 0 AND u + v <= 1 AND t >= 0 AND t <= 1 AS hit FROM (SELECT *, "
            + f"{_dot(_d('p', 'a'), ['hx', 'hy', 'hz'])} / det AS u, {_dot(['dx', 'dy', 'dz'], ['kx', 'ky', 'kz'])} / det AS v, {_dot(_d('p', 'r'), ['kx', 'ky', 'kz'])} / det AS t FROM (SELECT *, {_dot(_d('p', 'q'), ['hx', 'hy', 'hz'])} AS det FROM (SELECT *, "
            + ", ".join(f"{e} AS h{c}" for e, c in zip(_cross(["dx", "dy", "dz"], _d("p", "r")), _AX, strict=True)) + ", " + ", ".join(f"{e} AS k{c}" for e, c in zip(_cross(_d("p", "a"), _d("p", "q")), _AX, strict=True))
            + " FROM (SELECT *, bx - ax AS dx, by_ - ay AS dy, bz - az AS dz FROM g))))",
        ),
    ),
    "r11_visible_bricks": (
        lambda s, d: ge.visible_bricks(_bricks(s, d), 2, (-5.0, -6.0, -7.0), (0.6, 0.0, 0.8), 0.9, 5, 0.05).select("bz", "by", "bx", F.floor(F.col("d2") + 0.5).cast("long").alias("d2"), "level"),
        with_sql("voxel", f", {BRICKS}, t AS (SELECT *, (bx + 0.5e0) * 2 + 5 AS dx, (by_ + 0.5e0) * 2 + 6 AS dy, (bz + 0.5e0) * 2 + 7 AS dz FROM bk), u AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM t) SELECT bz, by_ AS by, bx, CAST(floor(d2 + 0.5) AS BIGINT) AS d2, {_lv('sqrt(d2)')} AS level FROM u WHERE dx * 0.6e0 + dz * 0.8e0 >= 0.9e0 * sqrt(d2)"),
    ),
    "r12_auto_coarsening": (
        lambda s, d: ge.coarsest_that_fits(_bricks(s, d), 5, 200),
        with_sql("voxel", f", {BRICKS}, l AS (SELECT level, count(*) AS n FROM (SELECT DISTINCT CAST(level AS INT) AS level, bz >> level AS a, by_ >> level AS b, bx >> level AS c FROM bk, (SELECT unnest(range(0, 5)) AS level)) GROUP BY 1) SELECT level, n FROM l ORDER BY CASE WHEN n <= 200 THEN level ELSE 1000 - level END LIMIT 1"),
    ),
    "f12_surface_chunks": (
        lambda s, d: ge.chunks_near(surface_points(s, d), 10.0, 64).select(*(F.col(c).cast("int").alias(c) for c in ("cz", "cy", "cx"))),
        with_sql("sp", "SELECT DISTINCT CAST(a AS INT) AS cz, CAST(b AS INT) AS cy, CAST(c AS INT) AS cx FROM (SELECT unnest(range(CAST(floor((z - 10) / 64) AS BIGINT), CAST(floor((z + 10) / 64) AS BIGINT) + 1)) AS a, y, x FROM sp) t, LATERAL (SELECT unnest(range(CAST(floor((y - 10) / 64) AS BIGINT), CAST(floor((y + 10) / 64) AS BIGINT) + 1)) AS b) u, LATERAL (SELECT unnest(range(CAST(floor((x - 10) / 64) AS BIGINT), CAST(floor((x + 10) / 64) AS BIGINT) + 1)) AS c) w WHERE a >= 0 AND b >= 0 AND c >= 0"),
    ),
    "f5_confident_cells": (
        lambda s, d: query_points(s, d).select("pt_id", it.confidence(F.col("x"), F.col("pt_id") % 4).alias("conf")).where("conf > 0.25").select("pt_id"),
        with_sql("qp", "SELECT pt_id FROM qp WHERE greatest(1 - least(x, 12) / 12, CASE WHEN pt_id % 4 >= 2 THEN 0.95 WHEN pt_id % 4 = 1 THEN 0.75 ELSE 0 END) > 0.25"),
    ),
    "f6_neighbour_mean_veto": (
        lambda s, d: su.around(surface_points(s, d), {"p": (0, 0), "r": (0, 1), "l": (0, -1), "d": (1, 0), "u": (-1, 0)}).where("p is not null").select("seg_id", "j", "i", F.expr("try_divide(aggregate(filter(array(r.z, l.z, d.z, u.z), v -> v is not null), 0D, (a, v) -> a + v), size(filter(array(r.z, l.z, d.z, u.z), v -> v is not null)))").alias("m")).where("m >= 80 and m <= 110").select("seg_id", "j", "i"),
        with_sql("sp", ", o(dj, di) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)), m AS (SELECT p.seg_id, p.j, p.i, avg(n.z) AS m FROM sp p, o JOIN sp n ON n.seg_id = p.seg_id AND n.j = p.j + dj AND n.i = p.i + di GROUP BY 1, 2, 3) SELECT seg_id, j, i FROM m WHERE m >= 80 AND m <= 110"),
    ),
    "f15_distrusted_fit": (
        lambda s, d: qu.distrusted(query_points(s, d).select("pt_id", (F.col("z") / 31).alias("conf"), ((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")) / 31).alias("residual"), (F.col("pt_id") % 4).alias("donors")), 10.0).select("pt_id", _scaled("conf")),
        with_sql("qp", f", r AS (SELECT pt_id, z / 31 AS conf, (x - y) * (x - y) / 31 AS r, pt_id % 4 AS donors FROM qp), t AS (SELECT greatest(5, 2.5e0 * sqrt(avg(r * r))) AS far FROM r) SELECT pt_id, {_sqls('CASE WHEN abs(r) > far AND donors < 2 THEN least(0.25, conf) ELSE conf END', 'conf')} FROM r, t"),
    ),
    "g11_level_chain_sample": (
        lambda s, d: (lambda q, v: sa.nearest(q, v.where("v >= 200")).withColumnRenamed("v", "a").join(sa.nearest(q, vo.block_max(v, 2), 2).withColumnRenamed("v", "b"), "pt_id").join(sa.nearest(q, vo.block_max(v, 4), 4).withColumnRenamed("v", "c"), "pt_id").select("pt_id", F.coalesce(F.nullif("a", F.lit(0)), F.nullif("b", F.lit(0)), F.col("c")).alias("v")))(query_points(s, d), voxels(s, d)),
        with_sql("qp voxel", ", b AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, max(v) AS v FROM voxel GROUP BY 1, 2, 3), c AS (SELECT z // 4 AS z, y // 4 AS y, x // 4 AS x, max(v) AS v FROM voxel GROUP BY 1, 2, 3) SELECT pt_id, coalesce(a.v, b.v, c.v, 0) AS v FROM qp LEFT JOIN voxel a ON a.v >= 200 AND a.z = floor(qp.z) AND a.y = floor(qp.y) AND a.x = floor(qp.x) LEFT JOIN b ON b.z = floor(qp.z / 2) AND b.y = floor(qp.y / 2) AND b.x = floor(qp.x / 2) LEFT JOIN c ON c.z = floor(qp.z / 4) AND c.y = floor(qp.y / 4) AND c.x = floor(qp.x / 4)"),
    ),
    "g13_span_average": (
        lambda s, d: (lambda q, v: sa.trilinear(q.select(F.struct("pt_id", "k").alias("pt_id"), "x", "y", (F.col("z") + F.col("k")).alias("z")), v).groupBy(F.col("pt_id.pt_id").alias("pt_id")).agg(F.avg("value").alias("value")).select("pt_id", _scaled("value")))(query_points(s, d).withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(1)))), voxels(s, d)),
        with_sql("qp voxel", ", q AS (SELECT pt_id, k, x, y, z + k AS z FROM qp, (SELECT unnest(range(-1, 2)) AS k)), t AS (SELECT q.pt_id, sum(abs(1 - dx - (q.x - floor(q.x))) * abs(1 - dy - (q.y - floor(q.y))) * abs(1 - dz - (q.z - floor(q.z))) * v.v) / 3 AS value FROM q, (VALUES (0), (1)) a(dz), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dx) JOIN voxel v ON v.z = CAST(floor(q.z) AS INT) + dz AND v.y = CAST(floor(q.y) AS INT) + dy AND v.x = CAST(floor(q.x) AS INT) + dx GROUP BY 1) SELECT pt_id, " + _sqls("coalesce(value, 0)", "value") + " FROM qp LEFT JOIN t USING (pt_id)"),
    ),
    "g24_window_arithmetic": (
        lambda s, d: samples(s, d).select("idx", ge.snapped(F.col("ns") - 500, 64).alias("snap"), ge.ring((F.col("ns") - 500).cast("int"), 24).alias("layer")),
        with_sql("sample", "SELECT idx, CAST(floor((ns - 500) / 64e0) * 64 AS INT) AS snap, CAST((((ns - 500) % 24) + 24) % 24 AS INT) AS layer FROM sample"),
    ),
    "t3_t4_support_order": (
        lambda s, d: qu.candidates(surface_points(s, d), _sizes(s, d)),
        with_sql(
            "sp",
            f", {_GRID50}, o(dj, di) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)), n AS (SELECT c.seg_id, c.j, c.i, count(*) AS n8, CAST(count(*) FILTER (dj = 0 OR di = 0) AS BIGINT) AS n4 FROM cell c, o JOIN sp ON sp.seg_id = c.seg_id AND sp.j = c.j + dj AND sp.i = c.i + di WHERE NOT EXISTS (SELECT 1 FROM sp q WHERE q.seg_id = c.seg_id AND q.j = c.j AND q.i = c.i) GROUP BY 1, 2, 3)"
            + " SELECT *, 4 * n4 + n8 AS score, row_number() OVER (PARTITION BY seg_id ORDER BY 8 - n8, j * 50 + i) AS by_support, row_number() OVER (PARTITION BY seg_id ORDER BY 4 * n4 + n8 DESC, j * 50 + i) AS by_score FROM n",
        ),
    ),
    "u2_first_names": (
        lambda s, d: table(s, d, "customer").groupBy((F.col("c_custkey") % 37).alias("name")).agg(F.min("c_custkey").alias("seq")),
        "SELECT c_custkey % 37 AS name, min(c_custkey) AS seq FROM customer GROUP BY 1",
    ),
    "u3_distinct_paths": (
        lambda s, d: query_points(s, d).select(F.floor(F.col("x") / 8).cast("int").alias("bx"), F.floor(F.col("y") / 8).cast("int").alias("by"), (F.col("pt_id") % 50).alias("path")).distinct(),
        with_sql("qp", "SELECT DISTINCT CAST(floor(x / 8) AS INT) AS bx, CAST(floor(y / 8) AS INT) AS by, pt_id % 50 AS path FROM qp"),
    ),
    "u5_occupancy_membership": (
        lambda s, d: query_points(s, d).select("pt_id", *(F.floor(F.col(c) / 2).cast("int").alias(c) for c in _AX)).join(voxels(s, d).where("v > 240").select(*(F.expr(f"cast({c} div 2 as int)").alias(c) for c in _AX)).distinct(), list(_AX), "left_semi").select("pt_id"),
        with_sql("qp voxel", "SELECT pt_id FROM qp WHERE EXISTS (SELECT 1 FROM voxel v WHERE v.v > 240 AND v.x // 2 = floor(qp.x / 2) AND v.y // 2 = floor(qp.y / 2) AND v.z // 2 = floor(qp.z / 2))"),
    ),
    "m1_stale_maps": (
        lambda s, d: qu.stale_maps(_stored_maps(s, d), surface_points(s, d)),
        with_sql("sp", ", m AS (SELECT CAST(p_partkey // 500 AS INT) AS seg_id, CAST(max(p_partkey % 50) + 1 AS INT) AS gw, CAST(max((p_partkey // 50) % 10) + 1 AS INT) AS gh, count(*) FILTER (p_size % 17 <> 0 OR (p_partkey // 500) % 2 = 1) AS nvalid FROM part GROUP BY 1), n AS (SELECT seg_id, max(i) + 1 AS gw, max(j) + 1 AS gh, count(*) AS nvalid FROM sp GROUP BY 1) SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.seg_id = m.seg_id AND n.gw = m.gw AND n.gh = m.gh AND n.nvalid = m.nvalid)"),
    ),
    "m3_mask_stamp": (
        lambda s, d: labels(s, d).groupBy("y", "x").agg(F.max(F.when((F.col("x") - 12) ** 2 + (F.col("y") - 15) ** 2 <= 36, 2).otherwise(F.col("cls") % 2)).cast("int").alias("cls")),
        with_sql("lab", "SELECT y, x, CAST(max(CASE WHEN (x - 12) * (x - 12) + (y - 15) * (y - 15) <= 36 THEN 2 ELSE cls % 2 END) AS INT) AS cls FROM lab GROUP BY 1, 2"),
    ),
    "m4_versioned_axis": (
        lambda s, d: ax.undone(_axis(s, d).select("z", _scaled("x"), _scaled("y")), samples(s, d).select(F.col("idx").alias("seq"), (F.col("ns") % 32).cast("int").alias("z"), F.when(F.col("ns") % 5 > 0, F.col("ns")).alias("x"), F.when(F.col("ns") % 5 > 0, F.col("idx")).alias("y")), 64),
        with_sql("voxel sample", f", {AXIS}, e AS (SELECT idx AS seq, CAST(ns % 32 AS INT) AS z, CASE WHEN ns % 5 > 0 THEN ns END AS x, CASE WHEN ns % 5 > 0 THEN idx END AS y FROM sample WHERE idx < (SELECT min(idx) FROM (SELECT idx FROM sample ORDER BY idx DESC LIMIT 64))), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY seq DESC) AS n FROM e) WHERE n = 1) SELECT z, {_sqls('x', 'x')}, {_sqls('y', 'y')} FROM axis WHERE z NOT IN (SELECT z FROM l) UNION ALL SELECT z, x, y FROM l WHERE x IS NOT NULL"),
    ),
    "k10_band_cut": (lambda s, d: vo.region(voxels(s, d), (8, 0, 0), (4, 32, 32)), with_sql("voxel grid dense", "SELECT * FROM dense WHERE z >= 8 AND z < 12")),
    "k6_label_load": (
        lambda s, d: labels(s, d).select("z", "y", "x", (F.col("cls") * 2).alias("cls")).where("cls < 9"),
        with_sql("lab", "SELECT z, y, x, cls * 2 AS cls FROM lab WHERE cls * 2 < 9"),
    ),
    "s22_predicted_cell": (
        lambda s, d: predictions(s, d).select("vec_id", "py", "px", F.when(F.col("p") * 255 < 60, 0).otherwise(F.floor(F.col("p") * 255)).cast("int").alias("v")).groupBy("vec_id", F.expr("cast(py div 2 as int)").alias("py"), F.expr("cast(px div 2 as int)").alias("px")).agg(F.expr("cast((sum(v) + 2) div 4 as int)").alias("v")),
        with_sql("pred", ", t AS (SELECT vec_id, py, px, CASE WHEN p * 255 < 60 THEN 0 ELSE CAST(floor(p * 255) AS INT) END AS v FROM pred) SELECT vec_id, CAST(py // 2 AS INT) AS py, CAST(px // 2 AS INT) AS px, CAST((sum(v) + 2) // 4 AS INT) AS v FROM t GROUP BY 1, 2, 3"),
    ),
}
