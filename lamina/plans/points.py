"""Queries on points, axis, samples, labels, predictions, and iterated ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.derive import labels, predictions, query_points, samples, surface_points, voxels, with_sql
from lamina.operators import axis as ax
from lamina.operators import iterate as it
from lamina.operators import labels as la
from lamina.operators import sampling as sa
from lamina.operators import stats as st
from lamina.operators import surface as su
from lamina.operators import volume as vo
from lamina.plans.surfaces import QUAD, _len, _n
from lamina.session import table

SHAPE = (32, 32, 32)
MATRIX = ((0.5, 0.0, 0.25, 3.0), (0.0, 0.75, 0.0, -2.0), (0.25, 0.0, 0.5, 4.0))


EYE = (-4, -20, 7)
_FROM_EYE = "sqrt(" + " + ".join(f"({c} - {e}) * ({c} - {e})" for c, e in zip("xyz", EYE, strict=True)) + ")"


def _scaled(c, digits=6):
    return F.floor(F.col(c) * 10**digits + 0.5).cast("long").alias(c)


def _sqls(expr, name, digits=6):
    return f"CAST(floor(({expr}) * {10**digits} + 0.5) AS BIGINT) AS {name}"


_T = "tap AS (SELECT p.*, CAST(floor(p.x) AS INT) + dx AS ix, CAST(floor(p.y) AS INT) + dy AS iy, CAST(floor(p.z) AS INT) + dz AS iz, abs(1 - dx - (x - floor(x))) AS wx, abs(1 - dy - (y - floor(y))) AS wy, abs(1 - dz - (z - floor(z))) AS wz, dx, dy, dz FROM {0} p, (VALUES (0), (1)) a(dz), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dx))"
_TRI = (
    ", s AS (SELECT t.pt_id, sum(wx * wy * wz * v.v) AS value, sum((2 * dx - 1) * wy * wz * v.v) AS gx, sum(wx * (2 * dy - 1) * wz * v.v) AS gy, sum(wx * wy * (2 * dz - 1) * v.v) AS gz FROM tap t JOIN voxel v ON v.z = iz AND v.y = iy AND v.x = ix GROUP BY 1)"
)
AXIS = "axis AS (SELECT z, sum(x * v) / CAST(sum(v) AS DOUBLE) AS x, sum(y * v) / CAST(sum(v) AS DOUBLE) AS y FROM voxel WHERE v > 24 GROUP BY z HAVING sum(v) >= 384)"
THETA = "c AS (SELECT seg_id, j, i, atan2(y - (seg_id * 200 + 100), x - 490) AS theta, i / 25e0 AS wind FROM sp)"
_WRAP = "CASE WHEN a.theta - b.theta > pi() THEN a.theta - b.theta - 2 * pi() WHEN a.theta - b.theta <= -pi() THEN a.theta - b.theta + 2 * pi() ELSE a.theta - b.theta END / (2 * pi())"


def _axis(s, d):
    return ax.centroids(voxels(s, d), 24)


def _cells(s, d):
    sp = surface_points(s, d)
    return sp.select("seg_id", "j", "i", F.atan2(F.col("y") - (F.col("seg_id") * 200 + 100), F.col("x") - 490).alias("theta"), (F.col("i") / 25.0).alias("wind"))


def _tiles(s, d):
    p = predictions(s, d)
    return p.select(F.expr("vec_id div 4").alias("map"), F.lit(0).alias("ty"), ((F.col("vec_id") % 4) * 4).cast("int").alias("tx"), "py", "px", "p")


def _sizes(s, d):
    return surface_points(s, d).groupBy("seg_id").agg(F.lit(10).alias("h"), F.lit(50).alias("w"))


def _rays(s, d):
    """Voxel rows, cut into four rays of 8 steps each, as rays of cells."""
    v = vo.dense(voxels(s, d), SHAPE)
    return v.select(F.expr("cast(x div 8 as int)").alias("seg_id"), F.col("z").alias("j"), F.col("y").alias("i"), (F.col("x") % 8 - 4).alias("step"), "v")


RAYS = "r AS (SELECT CAST(x // 8 AS INT) AS seg_id, z AS j, y AS i, x % 8 - 4 AS step, v FROM dense)"
_O4 = "o(dj, di) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0))"


def _relax_sql(rounds):
    out, now = [], "c"
    for k in range(rounds):
        out.append(f"m{k} AS (SELECT a.seg_id, a.j, a.i, avg(b.wind + {_WRAP}) AS mean FROM {now} a, o JOIN {now} b ON b.seg_id = a.seg_id AND b.j = a.j + dj AND b.i = a.i + di WHERE abs({_WRAP}) <= 0.25 GROUP BY 1, 2, 3)")
        out.append(f"c{k} AS (SELECT a.seg_id, a.j, a.i, a.theta, CASE WHEN (a.i = 25 AND a.j = 5) OR mean IS NULL THEN a.wind ELSE mean END AS wind FROM {now} a LEFT JOIN m{k} USING (seg_id, j, i))")
        now = f"c{k}"
    return ", ".join(out), now


def _membrane_sql(rounds):
    out, now = [], "k0"
    for k in range(rounds):
        out.append(f"f{k} AS (SELECT m.seg_id, m.j, m.i, avg(n.f) AS f FROM miss m, o JOIN {now} n ON n.seg_id = m.seg_id AND n.j = m.j + dj AND n.i = m.i + di GROUP BY 1, 2, 3)")
        out.append(f"n{k} AS (SELECT * FROM k0 UNION ALL SELECT * FROM f{k})")
        now = f"n{k}"
    return ", ".join(out), f"f{rounds - 1}"


def _gap_sql(passes):
    """Mean values of cells with three bright voxels or more; each pass gives empty cells the mean of their neighbours."""
    out, now = [], "g0"
    for k in range(passes):
        out.append(f"n{k} AS MATERIALIZED (SELECT z + dz AS z, y + dy AS y, x + dx AS x, avg(g) AS g FROM {now}, o GROUP BY 1, 2, 3)")
        out.append(f"g{k + 1} AS MATERIALIZED (SELECT * FROM {now} UNION ALL SELECT * FROM n{k} WHERE z BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 AND NOT EXISTS (SELECT 1 FROM {now} g WHERE g.z = n{k}.z AND g.y = n{k}.y AND g.x = n{k}.x))")
        now = f"g{k + 1}"
    return with_sql("voxel", f""", g0 AS (SELECT z // 4 AS z, y // 4 AS y, x // 4 AS x, avg(v) AS g FROM voxel WHERE v >= 235 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
o(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)), {", ".join(out)} SELECT CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {_sqls("g", "g", 4)} FROM {now}""")


_GRID50 = "cell AS (SELECT s.seg_id, CAST(a.k AS INT) AS j, CAST(b.k AS INT) AS i FROM (SELECT DISTINCT seg_id FROM sp) s, (SELECT unnest(range(0, 10)) AS k) a, (SELECT unnest(range(0, 50)) AS k) b)"

QUERIES = {
    "g1_nearest_sample": (
        lambda s, d: sa.nearest(query_points(s, d), voxels(s, d)),
        with_sql("qp voxel", "SELECT pt_id, CAST(coalesce(v, 0) AS INT) AS v FROM qp LEFT JOIN voxel ON voxel.z = floor(qp.z) AND voxel.y = floor(qp.y) AND voxel.x = floor(qp.x)"),
    ),
    "g2_trilinear_sample": (
        lambda s, d: sa.trilinear(query_points(s, d), voxels(s, d)).select("pt_id", *(_scaled(c) for c in ("value", "gx", "gy", "gz"))),
        with_sql("qp voxel", ", " + _T.format("qp") + _TRI + " SELECT pt_id, " + ", ".join(_sqls(f"coalesce({c}, 0)", c) for c in ("value", "gx", "gy", "gz")) + " FROM qp LEFT JOIN s USING (pt_id)"),
    ),
    "g3_clamped_sample": (
        lambda s, d: sa.clamped(query_points(s, d).select("pt_id", *((F.col(c) * 1.0625 - 1).alias(c) for c in "xyz")), voxels(s, d), SHAPE).select("pt_id", _scaled("value")),
        with_sql(
            "qp voxel",
            ", q AS (SELECT pt_id, x * 1.0625e0 - 1 AS x, y * 1.0625e0 - 1 AS y, z * 1.0625e0 - 1 AS z FROM qp), "
            + _T.format("q")
            + ", s AS (SELECT pt_id, sum(wx * wy * wz * v.v) AS value FROM tap t JOIN voxel v ON v.z = greatest(0, least(31, iz)) AND v.y = greatest(0, least(31, iy)) AND v.x = greatest(0, least(31, ix)) WHERE "
            + " AND ".join(f"t.{c} >= -0.5 AND t.{c} <= 31.5" for c in "xyz")
            + " GROUP BY 1) SELECT pt_id, " + _sqls("coalesce(value, 0)", "value") + " FROM q LEFT JOIN s USING (pt_id)",
        ),
    ),
    "g4_affine_resample": (
        lambda s, d: sa.resampled(voxels(s, d), MATRIX, SHAPE),
        with_sql(
            "grid voxel",
            ", q AS (SELECT (z * 32 + y) * 32 + x AS pt_id, " + ", ".join(f"{r[0]!r}e0 * x + {r[1]!r}e0 * y + {r[2]!r}e0 * z + {r[3]!r}e0 AS {c}" for r, c in zip(MATRIX, "xyz", strict=True)) + " FROM grid), "
            + _T.format("q") + _TRI
            + " SELECT CAST(pt_id // 1024 AS INT) AS z, CAST(pt_id // 32 % 32 AS INT) AS y, CAST(pt_id % 32 AS INT) AS x, CAST(floor(coalesce(value, 0) + 0.5) AS INT) AS v FROM q LEFT JOIN s USING (pt_id)",
        ),
    ),
    "g15_level_choice": (
        lambda s, d: query_points(s, d).select("pt_id", sa.level_for(F.expr(_FROM_EYE), 0.05, 1.0, 6).alias("level")),
        with_sql("qp", f"SELECT pt_id, CAST(least(greatest(floor(log2(greatest({_FROM_EYE} * 0.05e0 / 1, 1))), 0), 5) AS INT) AS level FROM qp"),
    ),
    "g16_level_fallback": (
        lambda s, d: voxels(s, d).select((F.col("v") % 4).alias("desired")).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("desired", "level", sa.fallback_rank(F.col("level"), F.col("desired")).alias("rank")),
        with_sql("voxel", "SELECT DISTINCT v % 4 AS desired, CAST(level AS INT) AS level, CAST(CASE WHEN level >= v % 4 THEN level - v % 4 ELSE 1000 + v % 4 - level END AS INT) AS rank FROM voxel, (SELECT unnest(range(0, 4)) AS level)"),
    ),
    "g9_layer_stack": (
        lambda s, d: sa.layer_stack(surface_points(s, d).select("seg_id", "j", "i", (F.col("x") / 32).alias("x"), (F.col("y") / 32).alias("y"), (F.col("z") / 32).alias("z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz")), voxels(s, d), 5),
        with_sql(
            "sp voxel",
            ", q AS (SELECT {'s': seg_id, 'j': j, 'i': i, 'l': l} AS pt_id, x / 32 AS x, y / 32 AS y, z / 32 + (l - 2) AS z FROM sp, (SELECT unnest(range(0, 5)) AS l)), " + _T.format("q") + _TRI
            + " SELECT pt_id.s AS seg_id, pt_id.j AS j, pt_id.i AS i, CAST(pt_id.l AS INT) AS layer, CAST(least(255, greatest(0, floor(coalesce(value, 0) + 1e-9))) AS INT) AS v FROM q LEFT JOIN s USING (pt_id)",
        ),
    ),
    "g10_layer_stack_verso": (
        lambda s, d: sa.layer_stack(surface_points(s, d).select("seg_id", "j", "i", (F.col("x") / 32).alias("x"), (F.col("y") / 32).alias("y"), (F.col("z") / 32).alias("z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz")), voxels(s, d), 3, flip=True),
        with_sql(
            "sp voxel",
            ", q AS (SELECT {'s': seg_id, 'j': j, 'i': i, 'l': 2 - l} AS pt_id, x / 32 AS x, y / 32 AS y, z / 32 + (l - 1) AS z FROM sp, (SELECT unnest(range(0, 3)) AS l)), " + _T.format("q") + _TRI
            + " SELECT pt_id.s AS seg_id, pt_id.j AS j, pt_id.i AS i, CAST(pt_id.l AS INT) AS layer, CAST(least(255, greatest(0, floor(coalesce(value, 0) + 1e-9))) AS INT) AS v FROM q LEFT JOIN s USING (pt_id)",
        ),
    ),
    "a10_slice_centroids": (lambda s, d: _axis(s, d).select("z", _scaled("x"), _scaled("y")), with_sql("voxel", f", {AXIS} SELECT z, {_sqls('x', 'x')}, {_sqls('y', 'y')} FROM axis")),
    "w8_axis_moving_average": (
        lambda s, d: ax.smoothed(_axis(s, d)).select("z", _scaled("x"), _scaled("y")),
        with_sql("voxel", f", {AXIS} SELECT z, {_sqls('avg(x) OVER w', 'x')}, {_sqls('avg(y) OVER w', 'y')} FROM axis WINDOW w AS (ORDER BY z ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    ),
    "g18_j14_axis_at_points": (
        lambda s, d: ax.interpolated(query_points(s, d), _axis(s, d)).select("pt_id", _scaled("x"), _scaled("y")),
        with_sql(
            "voxel qp",
            f", {AXIS}, i AS (SELECT z AS z0, x AS x0, y AS y0, lead(z) OVER w AS z1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM axis WINDOW w AS (ORDER BY z))"
            f" SELECT pt_id, {_sqls('x0 + (qp.z - z0) / (z1 - z0) * (x1 - x0)', 'x')}, {_sqls('y0 + (qp.z - z0) / (z1 - z0) * (y1 - y0)', 'y')} FROM qp JOIN i ON qp.z >= z0 AND qp.z < z1",
        ),
    ),
    "g19_w9_axis_gaussian": (
        lambda s, d: ax.gaussian(_axis(s, d), 3.0, 32).select("z", _scaled("x"), _scaled("y")),
        with_sql("voxel", f", {AXIS}, g AS (SELECT CAST(unnest(range(0, 32)) AS INT) AS z) SELECT g.z, " + ", ".join(_sqls(f"sum(exp(-0.5 * (g.z - a.z) * (g.z - a.z) / 9e0) * {c}) / sum(exp(-0.5 * (g.z - a.z) * (g.z - a.z) / 9e0))", c) for c in "xy") + " FROM g JOIN axis a ON abs(g.z - a.z) <= 9 GROUP BY g.z"),
    ),
    "g12_nearest_control": (
        lambda s, d: ax.nearest_control(query_points(s, d), _axis(s, d)).select("pt_id", "z"),
        with_sql("voxel qp", f", {AXIS}, t AS (SELECT pt_id, a.z, row_number() OVER (PARTITION BY pt_id ORDER BY abs(qp.z - a.z), a.z) AS n FROM qp, axis a) SELECT pt_id, z FROM t WHERE n = 1"),
    ),
    "g20_cylinder": (
        lambda s, d: query_points(s, d).select("pt_id", *(F.floor(e * 1e6 + 0.5).cast("long").alias(n) for e, n in zip(ax.cylinder(F.col("x"), F.col("y"), F.lit(15.3), F.lit(16.1)), ("rho", "theta"), strict=True))),
        with_sql("qp", f"SELECT pt_id, {_sqls('sqrt((x - 15.3e0) * (x - 15.3e0) + (y - 16.1e0) * (y - 16.1e0))', 'rho')}, {_sqls('atan2(y - 16.1e0, x - 15.3e0)', 'theta')} FROM qp"),
    ),
    "w10_angle_unwrap": (
        lambda s, d: ax.neighbour_windings(_cells(s, d)).select("seg_id", "j", "i", _scaled("mean")),
        with_sql("sp", f", {THETA}, o AS (SELECT a.k AS dj, b.k AS di FROM (SELECT unnest(range(-1, 2)) AS k) a, (SELECT unnest(range(-1, 2)) AS k) b WHERE a.k <> 0 OR b.k <> 0) SELECT a.seg_id, a.j, a.i, {_sqls(f'avg(b.wind + {_WRAP})', 'mean')} FROM c a, o JOIN c b ON b.seg_id = a.seg_id AND b.j = a.j + dj AND b.i = a.i + di GROUP BY 1, 2, 3"),
    ),
    "w11_winding_relaxation": (
        lambda s, d: ax.relaxed_windings(_cells(s, d), 3, (F.col("i") == 25) & (F.col("j") == 5)).select("seg_id", "j", "i", _scaled("wind"), _scaled("err")),
        with_sql("sp", f", {THETA}, {_O4}, {_relax_sql(3)[0]} SELECT r.seg_id, r.j, r.i, {_sqls('r.wind', 'wind')}, {_sqls('abs(r.wind - c.wind)', 'err')} FROM {_relax_sql(3)[1]} r JOIN c USING (seg_id, j, i)"),
    ),
    "a20_winding_quality": (
        lambda s, d: ax.relaxed_windings(_cells(s, d), 2, (F.col("i") == 25) & (F.col("j") == 5)).groupBy("seg_id").agg(F.count("*").alias("n"), F.count_if(F.col("err") > 0.3).alias("wrapped")),
        with_sql("sp", f", {THETA}, {_O4}, {_relax_sql(2)[0]} SELECT seg_id, count(*) AS n, count(*) FILTER (abs(r.wind - c.wind) > 0.3) AS wrapped FROM {_relax_sql(2)[1]} r JOIN c USING (seg_id, j, i) GROUP BY 1"),
    ),
    "i6_spiral_normal_equations": (
        lambda s, d: surface_points(s, d).select(*(F.col(c).cast("long").alias(c) for c in "xyz")).agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))),
        with_sql("sp", "SELECT " + ", ".join(f"CAST(sum(CAST({a} AS BIGINT) * CAST({b} AS BIGINT)) AS BIGINT) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM sp"),
    ),
    "t6_axis_upsert": (
        lambda s, d: ax.upsert(_axis(s, d).select("z", _scaled("x"), _scaled("y")), samples(s, d).select(F.col("idx").alias("seq"), (F.col("ns") % 32).cast("int").alias("z"), F.when(F.col("ns") % 5 > 0, F.col("ns")).alias("x"), F.when(F.col("ns") % 5 > 0, F.col("idx")).alias("y"))),
        with_sql("voxel sample", f", {AXIS}, e AS (SELECT idx AS seq, CAST(ns % 32 AS INT) AS z, CASE WHEN ns % 5 > 0 THEN ns END AS x, CASE WHEN ns % 5 > 0 THEN idx END AS y FROM sample), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY seq DESC) AS n FROM e) WHERE n = 1) SELECT z, {_sqls('x', 'x')}, {_sqls('y', 'y')} FROM axis WHERE z NOT IN (SELECT z FROM l) UNION ALL SELECT z, x, y FROM l WHERE x IS NOT NULL"),
    ),
    "a12_latency_summary": (
        lambda s, d: st.summary(samples(s, d)),
        with_sql("sample", "SELECT metric, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total, " + ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ns) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + ", max(ns) AS max FROM sample GROUP BY 1"),
    ),
    "a13_upper_median": (lambda s, d: st.upper_median(samples(s, d), "metric", "ns"), with_sql("sample", "SELECT metric, list_sort(list(ns))[count(*) // 2 + 1] AS ns FROM sample GROUP BY 1")),
    "a14_tail_values": (
        lambda s, d: st.tail(samples(s, d), "metric", "ns").withColumnRenamed("ns", "p95").join(st.tail(samples(s, d), "metric", "ns", low=True).withColumnRenamed("ns", "p5"), "metric"),
        with_sql("sample", "SELECT metric, list_sort(list(ns))[count(*) - count(*) // 20] AS p95, list_sort(list(ns))[count(*) // 20 + 1] AS p5 FROM sample GROUP BY 1"),
    ),
    "w13_last_samples": (lambda s, d: st.last_samples(samples(s, d), 100), with_sql("sample", "SELECT metric, idx, ns FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY idx DESC) AS n FROM sample) WHERE n <= 100")),
    "a15_correlation": (
        lambda s, d: st.correlation(voxels(s, d), voxels(s, d).where("z > 0").select((F.col("z") - 1).alias("z"), "y", "x", "v")).select(_scaled("ncc"), "n"),
        with_sql("voxel", f"SELECT {_sqls('corr(a.v, b.v)', 'ncc')}, count(*) AS n FROM voxel a JOIN voxel b ON b.z = a.z + 1 AND b.y = a.y AND b.x = a.x"),
    ),
    "a21_volume_difference": (
        lambda s, d: st.difference(voxels(s, d), vo.low_cut(voxels(s, d), 100)).select("*", F.floor(st.psnr(F.col("ssd"), F.col("n")) * 1e6 + 0.5).cast("long").alias("psnr")),
        with_sql("voxel", f"SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS sad, CAST(sum(e * e) AS BIGINT) AS ssd, max(e) AS worst, {_sqls('10 * log10(65025e0 * count(*) / sum(e * e))', 'psnr')} FROM (SELECT CASE WHEN v >= 100 THEN 0 ELSE v END AS e FROM voxel)"),
    ),
    "a22_level_counts": (lambda s, d: query_points(s, d).groupBy(sa.level_for(F.expr(_FROM_EYE), 0.05, 1.0, 6).alias("level")).agg(F.count("*").alias("n")), with_sql("qp", f"SELECT CAST(least(greatest(floor(log2(greatest({_FROM_EYE} * 0.05e0, 1))), 0), 5) AS INT) AS level, count(*) AS n FROM qp GROUP BY 1")),
    "a23_prediction_rescale": (
        lambda s, d: predictions(s, d).groupBy("vec_id").agg(F.max(st.rescaled(F.col("p"))).alias("top"), F.avg(st.rescaled(F.col("p"))).alias("mean")).select("vec_id", _scaled("top"), _scaled("mean")),
        with_sql("pred", f"SELECT vec_id, {_sqls('max(least(greatest((p - 0.25) * 2, 0), 1))', 'top')}, {_sqls('avg(least(greatest((p - 0.25) * 2, 0), 1))', 'mean')} FROM pred GROUP BY 1"),
    ),
    "f4_prediction_threshold": (
        lambda s, d: predictions(s, d).select("vec_id", "py", "px", F.when(F.col("p") * 255 < 40, 0).otherwise(F.floor(F.col("p") * 255)).cast("int").alias("v")),
        with_sql("pred", "SELECT vec_id, py, px, CAST(CASE WHEN p * 255 < 40 THEN 0 ELSE floor(p * 255) END AS INT) AS v FROM pred"),
    ),
    "a24_m2_blended_tiles": (
        lambda s, d: _tiles(s, d).groupBy("map", (F.col("ty") + F.col("py")).alias("y"), (F.col("tx") + F.col("px")).alias("x")).agg((F.sum(F.col("p") * st.ramp(F.col("py"), 8) * st.ramp(F.col("px"), 8)) / F.sum(st.ramp(F.col("py"), 8) * st.ramp(F.col("px"), 8))).alias("p")).select("map", "y", "x", _scaled("p")),
        with_sql("pred", f", t AS (SELECT vec_id // 4 AS map, py AS y, CAST(vec_id % 4 * 4 AS INT) + px AS x, p, least(py + 1, 8 - py) * least(px + 1, 8 - px) AS w FROM pred) SELECT map, y, x, {_sqls('sum(p * w) / sum(w)', 'p')} FROM t GROUP BY 1, 2, 3"),
    ),
    "m5_quality_ladder": (
        lambda s, d: table(s, d, "part").select("p_partkey", *(e.alias(n) for e, n in zip(st.quality_ladder(F.col("p_size").cast("double"), F.col("p_partkey") % 8), ("quality", "tau"), strict=True))),
        "SELECT p_partkey, greatest(q / pow(2, p_partkey % 8), 1) AS quality, 2 * greatest(q / pow(2, p_partkey % 8), 1) AS tau FROM (SELECT *, CASE WHEN p_size <= 1.5 THEN 64e0 WHEN p_size <= 3.2 THEN 32 WHEN p_size <= 6 THEN 16 WHEN p_size <= 20 THEN 8 ELSE 2 END AS q FROM part)",
    ),
    "g22_voxel_size": (
        lambda s, d: table(s, d, "part").select("p_partkey", st.voxel_size(F.concat(F.lit("volume/"), F.col("p_size").cast("string"), F.lit(".5um_x/12um"))).alias("um")),
        "SELECT p_partkey, p_size + 0.5e0 AS um FROM part",
    ),
    "g23_physical_area": (
        lambda s, d: table(s, d, "part").select("p_partkey", st.physical_area((F.col("p_size") * F.col("p_size") * 4000).cast("double"), F.lit(8.0)).alias("area")),
        "SELECT p_partkey, CASE WHEN a >= 1e8 THEN format('{:.2f} cm2', a / 1e8) WHEN a >= 1e6 THEN format('{:.2f} mm2', a / 1e6) ELSE format('{:.0f} um2', a) END AS area FROM (SELECT p_partkey, CAST(p_size * p_size * 4000 AS DOUBLE) * 64 AS a FROM part)",
    ),
    "f11_safe_names": (
        lambda s, d: table(s, d, "part").select("p_partkey", st.safe_name(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("-" * 1), F.col("p_partkey").cast("string")))).alias("safe"), st.safe_name(F.concat(F.lit("seg_"), F.col("p_partkey").cast("string"))).alias("safe2")),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN regexp_full_match(p_name, '[A-Za-z0-9._][A-Za-z0-9._-]*') ELSE false END AS safe, true AS safe2 FROM part",
    ),
    "a11_label_counts": (lambda s, d: la.counts(labels(s, d)), with_sql("lab", "SELECT cls, count(*) AS n FROM lab GROUP BY 1")),
    "i19_label_paint": (
        lambda s, d: la.painted(labels(s, d), (10.5, 12.0, 14.25), 6.5, 8, SHAPE),
        with_sql("lab grid", ", b AS (SELECT * FROM grid WHERE (x - 10.5) * (x - 10.5) + (y - 12) * (y - 12) + (z - 14.25) * (z - 14.25) <= 42.25) SELECT * FROM lab WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.z = lab.z AND b.y = lab.y AND b.x = lab.x) UNION ALL SELECT z, y, x, 8 FROM b"),
    ),
    "i19_label_changed": (
        lambda s, d: la.changed(labels(s, d), (10.5, 12.0, 14.25), 6.5, 3, SHAPE),
        with_sql("lab grid", "SELECT count(*) AS changed FROM grid LEFT JOIN lab USING (z, y, x) WHERE (x - 10.5) * (x - 10.5) + (y - 12) * (y - 12) + (z - 14.25) * (z - 14.25) <= 42.25 AND coalesce(cls, 0) <> 3"),
    ),
    "i20_label_level": (lambda s, d: la.level(labels(s, d), 1), with_sql("lab", "SELECT CAST(z // 2 AS INT) AS z, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, cls FROM lab WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0")),
    "r8_label_tint": (lambda s, d: la.tinted(voxels(s, d), labels(s, d)), with_sql("voxel lab", "SELECT z, y, x, CAST(CASE WHEN cls IS NULL THEN v ELSE (2 * v + 32 * cls) // 3 END AS INT) AS v FROM voxel LEFT JOIN lab USING (z, y, x)")),
    "r8_overlay": (
        lambda s, d: la.overlaid(voxels(s, d), vo.low_cut(voxels(s, d), 120).select("z", "y", F.pmod(F.col("x") + 5, F.lit(32)).cast("int").alias("x"), "v"), 1.5, 220.0).select("z", "y", "x", _scaled("v", 4)),
        with_sql("voxel", f", o AS (SELECT z, y, (x + 5) % 32 AS x, CASE WHEN v >= 120 THEN v ELSE 0 END AS k FROM voxel) SELECT z, y, x, {_sqls('v + (220 - v) * least(1, coalesce(k, 0) / 255e0 * 1.5e0)', 'v', 4)} FROM voxel LEFT JOIN o USING (z, y, x)"),
    ),
    "r8_fuse": (
        lambda s, d: la.fused(voxels(s, d), voxels(s, d).select("z", "y", F.pmod(F.col("x") + 1, F.lit(32)).cast("int").alias("x"), "v"), 0.75, 60),
        with_sql("voxel", ", m AS (SELECT z, y, (x + 1) % 32 AS x, v AS m FROM voxel WHERE v >= 60), j AS (SELECT z, y, x, coalesce(v, 0) AS f, coalesce(m, 0) AS m FROM voxel FULL JOIN m USING (z, y, x)) SELECT z, y, x, CAST(floor((f + (m - f) * 0.75e0) * 100 + 0.5) AS BIGINT) AS r, CAST(f * 100 AS BIGINT) AS g, CAST(floor((f + (m - f) * 0.75e0) * 100 + 0.5) AS BIGINT) AS b FROM j"),
    ),
    "k5_dirty_bricks": (
        lambda s, d: la.dirty(labels(s, d).withColumn("gen", F.col("z") * 32 + F.col("y")), 700, 8),
        with_sql("lab", "SELECT CAST(z // 8 AS INT) AS z, CAST(y // 8 AS INT) AS y, CAST(x // 8 AS INT) AS x, max(z * 32 + y) AS gen, count(*) AS n FROM lab GROUP BY 1, 2, 3 HAVING max(z * 32 + y) > 700"),
    ),
    "i1_enclosed_holes": (
        lambda s, d: it.holes(surface_points(s, d), _sizes(s, d)),
        with_sql("sp", "").replace("WITH ", "WITH RECURSIVE ", 1)
        + f", {_GRID50}, e AS (SELECT * FROM cell WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.seg_id = cell.seg_id AND sp.j = cell.j AND sp.i = cell.i)), {_O4}, r AS (SELECT * FROM e WHERE i = 0 OR j = 0 OR i = 49 OR j = 9 UNION SELECT e.* FROM r, o JOIN e ON e.seg_id = r.seg_id AND e.j = r.j + dj AND e.i = r.i + di) SELECT * FROM e EXCEPT SELECT * FROM r",
    ),
    "w12_membrane_fill": (
        lambda s, d: it.membrane(surface_points(s, d), it.holes(surface_points(s, d), _sizes(s, d)), "z", 4).select("seg_id", "j", "i", _scaled("z")),
        with_sql("sp", "").replace("WITH ", "WITH RECURSIVE ", 1)
        + f", {_GRID50}, e AS (SELECT * FROM cell WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.seg_id = cell.seg_id AND sp.j = cell.j AND sp.i = cell.i)), {_O4}, r AS (SELECT * FROM e WHERE i = 0 OR j = 0 OR i = 49 OR j = 9 UNION SELECT e.* FROM r, o JOIN e ON e.seg_id = r.seg_id AND e.j = r.j + dj AND e.i = r.i + di), miss AS (SELECT * FROM e EXCEPT SELECT * FROM r), k0 AS (SELECT seg_id, j, i, z AS f FROM sp), {_membrane_sql(4)[0]} SELECT seg_id, j, i, {_sqls('f', 'z')} FROM {_membrane_sql(4)[1]}",
    ),
    "i11_rewind": (
        lambda s, d: it.rewound(surface_points(s, d).select("seg_id", "j", "i", (F.col("i") % 4).alias("state"), (F.col("j") + F.col("i")).alias("gen")), 30),
        with_sql("sp", "SELECT seg_id, j, i, i % 4 AS state, j + i AS gen FROM sp WHERE i % 4 = 1 AND j + i <= 30"),
    ),
    "i5_confidence": (
        lambda s, d: query_points(s, d).select("pt_id", F.floor(it.confidence(F.col("x"), F.col("pt_id") % 4) * 1e6 + 0.5).cast("long").alias("conf")),
        with_sql("qp", f"SELECT pt_id, {_sqls('greatest(1 - least(x, 12) / 12, CASE WHEN pt_id % 4 >= 2 THEN 0.95 WHEN pt_id % 4 = 1 THEN 0.75 ELSE 0 END)', 'conf')} FROM qp"),
    ),
    "i4_residual_terms": (
        lambda s, d: it.energy(surface_points(s, d), 20.0).select("seg_id", "j", "i", *(_scaled(c, 4) for c in ("dist_i", "dist_j", "straight_i", "straight_j", "planar"))),
        with_sql(
            "sp",
            "SELECT p.seg_id, p.j, p.i, "
            + ", ".join(
                [
                    _sqls("sqrt(" + " + ".join(f"(r.{c} - p.{c}) * (r.{c} - p.{c})" for c in "xyz") + ") - 20", "dist_i", 4),
                    _sqls("sqrt(" + " + ".join(f"(d.{c} - p.{c}) * (d.{c} - p.{c})" for c in "xyz") + ") - 20", "dist_j", 4),
                    _sqls(" + ".join(f"(r.{c} + l.{c} - 2 * p.{c}) * (r.{c} + l.{c} - 2 * p.{c})" for c in "xyz"), "straight_i", 4),
                    _sqls(" + ".join(f"(d.{c} + u.{c} - 2 * p.{c}) * (d.{c} + u.{c} - 2 * p.{c})" for c in "xyz"), "straight_j", 4),
                    _sqls("(" + " + ".join(f"{n} * (q.{c} - p.{c})" for n, c in zip(_n("r.", "p.", "d.", "p."), "xyz", strict=True)) + f") / {_len(_n('r.', 'p.', 'd.', 'p.'))}", "planar", 4),
                ]
            )
            + " FROM sp p"
            + "".join(f" LEFT JOIN sp {n} ON {n}.seg_id = p.seg_id AND {n}.j = p.j + {a} AND {n}.i = p.i + {b}" for n, a, b in (("r", 0, 1), ("l", 0, -1), ("d", 1, 0), ("u", -1, 0), ("q", 1, 1))),
        ),
    ),
    "i16_symmetric_dirichlet": (
        lambda s, d: it.symmetric_dirichlet(surface_points(s, d), 20.0).select("seg_id", "j", "i", _scaled("energy", 4)),
        with_sql("sp", f", {QUAD}, e AS (SELECT seg_id, j, i, (" + " + ".join(f"pow(q{c} - p{c}, 2) + pow(r{c} - p{c}, 2)" for c in "xyz") + ") / 400 AS eg, pow(" + _len(_n("q", "p", "r", "p")) + ", 2) / 160000 AS det2 FROM quad) SELECT seg_id, j, i, " + _sqls("eg + eg / det2", "energy", 4) + " FROM e WHERE det2 > 1e-12"),
    ),
    "i15_edge_snap": (
        lambda s, d: it.edge_snap(_rays(s, d)),
        with_sql("grid voxel dense", f", {RAYS}, t AS (SELECT a.seg_id, a.j, a.i, a.step, b.v - a.v AS rise FROM r a JOIN r b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i = a.i AND b.step = a.step + 1) SELECT seg_id, j, i, step, rise FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, j, i ORDER BY rise DESC, abs(step), step) AS n FROM t) WHERE n = 1 AND rise > 0"),
    ),
    "i9_first_minimum": (
        lambda s, d: it.first_minimum(_rays(s, d)),
        with_sql("grid voxel dense", f", {RAYS}, t AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM r WINDOW w AS (PARTITION BY seg_id, j, i ORDER BY step)) SELECT seg_id, j, i, min(step) AS step FROM t WHERE v <= b AND v < a GROUP BY 1, 2, 3"),
    ),
    "a16_gap_field": (
        lambda s, d: it.filled_gaps(voxels(s, d).where("v >= 235").groupBy(*(vo.half(c, 4) for c in vo.ZYX)).agg(F.avg("v").alias("g"), F.count("*").alias("n")).where("n >= 3").drop("n"), 4, (8, 8, 8)).select("z", "y", "x", _scaled("g", 4)),
        _gap_sql(4),
    ),
    "u1_k3_manifest_merge": (
        lambda s, d: it.merged_manifest(
            table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("size")),
            table(s, d, "supplier").select((F.col("s_suppkey") % 40).cast("string").alias("name"), F.col("s_suppkey").alias("seq"), F.col("s_nationkey").alias("size")),
        ),
        "WITH old AS (SELECT CAST(c_custkey AS VARCHAR) AS name, c_custkey AS seq, c_nationkey AS size FROM customer), new AS (SELECT * FROM (SELECT CAST(s_suppkey % 40 AS VARCHAR) AS name, s_suppkey AS seq, s_nationkey AS size, row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY s_suppkey) AS n FROM supplier) WHERE n = 1) SELECT * FROM old WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT name, seq, size FROM new",
    ),
    "u4_resume_keys": (
        lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("key")).join(table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")), "key", "left_anti"),
        "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    ),
}
