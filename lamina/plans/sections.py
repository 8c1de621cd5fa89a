"""Queries of cross-sections: paths in slices, and how surfaces lie along them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions.derive import surface_points, with_sql
from lamina.operators import residuals as re
from lamina.plans.points import _scaled, _sqls
from lamina.session import room, table
from lamina.sources import paths as pt

CELL_SIDE, RADIUS = 32, 20.0


def _tenth(s, d):
    return surface_points(s, d).select("seg_id", "j", "i", *((F.col(c) / 10).alias(c) for c in "xyz"))


def _path_points(s, d):
    """Of each four cells in a row a path in each family of planes, in the slice of its first cell."""
    w = Window.partitionBy("seg_id", "j").orderBy("i").rowsBetween(0, 3)
    rows = _tenth(s, d).withColumn("four", F.collect_list(F.struct("i", "x", "y", "z")).over(w)).where("size(four) = 4 and four[3].i = i + 3")
    rows = rows.select(((F.col("seg_id") * 10 + F.col("j")) * 50 + F.col("i")).cast("long").alias("path_id"), *"xyz", F.posexplode("four").alias("k", "p"))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    each = [F.struct(F.lit(n).alias("plane"), whole(w).alias("slice"), whole("p." + u).alias("u"), whole("p." + v).alias("v")) for n, (u, v, w) in re.PLANES.items()]
    return rows.select("path_id", "k", F.inline(F.array(*each)))


def _slices(s, d):
    """A folder of slices with all paths."""
    top = _tenth(s, d).agg(*(F.max(c).alias(c) for c in "xyz")).first()
    side = lambda c: int((top[c] or 0) + 0.5) + 1
    path = room(s, "slices")
    pt.write_slices(_path_points(s, d), path, {n: (side(u), side(v)) for n, (u, v, _) in re.PLANES.items()}, CELL_SIDE)
    return path


def _lines(s, d):
    return pt.slice_lines(s, _slices(s, d))


def _asked(s, d):
    """A place in a slice of each event."""
    e = table(s, d, "events")
    n = F.col("event_id")
    plane = F.when(n % 3 == 0, "xy").when(n % 3 == 1, "xz").otherwise("yz")
    return e.select(n.alias("pt_id"), plane.alias("plane"), (F.expr("event_id div 3") % 100).cast("int").alias("slice"), ((n * 7 % 1000) / 10).alias("u"), ((F.col("user_id") * 13 % 1000) / 10).alias("v"))


_PATHS = (
    "q AS (SELECT seg_id, j, i, x / 10 AS x, y / 10 AS y, z / 10 AS z FROM sp), r AS (SELECT a.*, (a.seg_id * 10 + a.j) * 50 + a.i AS path_id, b.i - a.i AS k, b.x AS bx, b.y AS by_, b.z AS bz, count(*) OVER (PARTITION BY a.seg_id, a.j, a.i) AS n FROM q a JOIN q b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i BETWEEN a.i AND a.i + 3),\n"
    "pts AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT '{n}' AS plane, CAST(floor({w} + 0.5) AS INT) AS slice, CAST(path_id AS BIGINT) AS path_id, CAST(k AS INT) AS k, floor({u} + 0.5) AS u, floor({v} + 0.5) AS v FROM r WHERE n = 4" for n, u, v, w in (("xy", "bx", "by_", "z"), ("xz", "bx", "bz", "y"), ("yz", "by_", "bz", "x")))
    + "), ln AS MATERIALIZED (SELECT a.plane, a.slice, a.path_id, a.k, a.u AS u0, a.v AS v0, b.u AS u1, b.v AS v1, p.u AS pu, p.v AS pv, n.u AS nu, n.v AS nv FROM pts a JOIN pts b ON b.plane = a.plane AND b.slice = a.slice AND b.path_id = a.path_id AND b.k = a.k + 1"
    " LEFT JOIN pts p ON p.plane = a.plane AND p.slice = a.slice AND p.path_id = a.path_id AND p.k = a.k - 1 LEFT JOIN pts n ON n.plane = a.plane AND n.slice = a.slice AND n.path_id = a.path_id AND n.k = a.k + 2)"
)


def _line_sql(pu, pv, au, av, bu, bv):
    du, dv = f"({bu} - {au})", f"({bv} - {av})"
    l2 = f"({du} * {du} + {dv} * {dv})"
    t = f"CASE WHEN {l2} > 1e-12 THEN least(1e0, greatest(0e0, (({pu} - {au}) * {du} + ({pv} - {av}) * {dv}) / {l2})) ELSE 0e0 END"
    return f"(pow({au} + ({t}) * {du} - {pu}, 2) + pow({av} + ({t}) * {dv} - {pv}, 2))"


def _align_sql():
    corner = {"p00": (0, 0), "p10": (0, 1), "p01": (1, 0), "p11": (1, 1)}
    quad = ("qd AS (SELECT p00.seg_id, p00.j, p00.i, " + ", ".join(f"{p}.{c} AS {p}{c}" for p in corner for c in "xyz") + " FROM q p00" + "".join(f" JOIN q {p} ON {p}.seg_id = p00.seg_id AND {p}.j = p00.j + {dj} AND {p}.i = p00.i + {di}" for p, (dj, di) in corner.items() if p != "p00") + ")")
    each = " UNION ALL ".join(
        f"SELECT seg_id, j, i, {k} AS turn, '{plane}' AS plane, " + ", ".join(f"{p}{c} AS {n}{m}" for p, n in zip(names, ("a", "b1", "b2", "c"), strict=True) for c, m in zip(axes, "uvw", strict=True)) + " FROM qd"
        for k, names in enumerate(re.TURNS) for plane, axes in re.PLANES.items()
    )
    return with_sql(
        "sp",
        f", {_PATHS}, {quad}, e0 AS ({each}), e1 AS (SELECT *, b1w - aw AS r1, b2w - aw AS r2, cw - aw AS rc FROM e0),\n"
        "e2 AS (SELECT *, CASE WHEN abs(rc) < 1e-9 THEN CASE WHEN abs(r1) > 1e-9 THEN 1 WHEN abs(r2) > 1e-9 THEN 2 END WHEN r1 * rc <= 0 THEN 1 WHEN r2 * rc <= 0 THEN 2 END AS pick FROM e1 WHERE NOT (r1 > 0 AND r2 > 0 AND rc > 0) AND NOT (r1 < 0 AND r2 < 0 AND rc < 0)),\n"
        "e3 AS (SELECT *, " + ", ".join(f"CASE WHEN pick = 1 THEN b1{m} ELSE b2{m} END AS b{m}" for m in "uvw") + ", CASE WHEN pick = 1 THEN r1 ELSE r2 END AS rb FROM e2 WHERE pick IS NOT NULL),\n"
        "e4 AS (SELECT *, -rc / (rb - rc) AS t, (bv - av) * (bw - cw) - (bw - aw) * (bv - cv) AS n0, (bw - aw) * (bu - cu) - (bu - au) * (bw - cw) AS n1, (bu - au) * (bv - cv) - (bv - av) * (bu - cu) AS nw FROM e3 WHERE abs(rb - rc) >= 1e-9),\n"
        "e5 AS (SELECT *, n0 * n0 + n1 * n1 + nw * nw AS n2, cu + t * (bu - cu) AS eu, cv + t * (bv - cv) AS ev FROM e4), e6 AS (SELECT *, sqrt((eu - au) * (eu - au) + (ev - av) * (ev - av)) AS len FROM e5 WHERE n2 >= 1e-18),\n"
        "ch AS MATERIALIZED (SELECT seg_id, j, i, turn, plane, CAST(round(aw) AS INT) AS slice, au, av, eu, ev, len, 0.5e0 * (1 - nw * nw / n2) AS weight, (au + eu) / 2 AS mu, (av + ev) / 2 AS mv FROM e6 WHERE len >= 1e-9),\n"
        "st AS MATERIALIZED (SELECT *, (u0 + u1) / 2 AS su, (v0 + v1) / 2 AS sv, sqrt((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0)) AS tl FROM ln),\n"
        "b AS MATERIALIZED (SELECT *, (su - mu) * (su - mu) + (sv - mv) * (sv - mv) AS d2 FROM ch JOIN st USING (plane, slice) WHERE tl >= 1e-6 AND (su - mu) * (su - mu) + (sv - mv) * (sv - mv) <= 6400),\n"
        "w AS (SELECT seg_id, j, i, turn, plane, any_value(weight) AS weight, count(*) AS n, sum(1 / greatest(10e0, d2)) AS w, sum((1 - abs((ev - av) / len * (-(v1 - v0) / tl) + -(eu - au) / len * ((u1 - u0) / tl))) / greatest(10e0, d2)) AS s FROM b WHERE d2 <= 4096 GROUP BY 1, 2, 3, 4, 5),\n"
        f"k AS (SELECT seg_id, j, i, turn, plane, {_line_sql('eu', 'ev', 'u0', 'v0', 'u1', 'v1')} AS d2e, CASE WHEN o = 0 THEN {_line_sql('au', 'av', 'pu', 'pv', 'u0', 'v0')} ELSE {_line_sql('au', 'av', 'u1', 'v1', 'nu', 'nv')} END AS d2a FROM b, (VALUES (0), (1)) x(o)),\n"
        "bs AS (SELECT seg_id, j, i, turn, plane, sqrt(d2a) / 16 AS f, sqrt(d2e) / 4 AS g FROM k WHERE d2e < 16 AND d2a < 256), bt AS (SELECT seg_id, j, i, turn, plane, f * (1 - g) + g AS loss, row_number() OVER (PARTITION BY seg_id, j, i, turn, plane ORDER BY 0.5e0 * (f + g), f * (1 - g) + g) AS nr FROM bs)\n"
        f"SELECT seg_id, j, i, CAST(turn AS INT) AS turn, plane, n, {_sqls('(10 * s / w + 0.1e0 * coalesce(loss, 1e0)) * weight', 'align_term', 5)} FROM w LEFT JOIN (SELECT * FROM bt WHERE nr = 1) bt USING (seg_id, j, i, turn, plane)",
    )


def _found_sql():
    """Paths by the buckets that their steps' boxes touch."""
    top = "tp AS (SELECT " + ", ".join(f"CAST(floor(max({c}) + 0.5) AS BIGINT) + 1 AS {n}" for c, n in (("x", "mx"), ("y", "my"), ("z", "mz"))) + " FROM q)"
    ext = "ex AS (SELECT 'xy' AS plane, mx AS w, my AS h FROM tp UNION ALL SELECT 'xz', mx, mz FROM tp UNION ALL SELECT 'yz', my, mz FROM tp)"
    cut = lambda c, s: (f"greatest(0, CAST(trunc({c} - {RADIUS!r}e0) AS BIGINT))", f"least({s}, CAST(trunc({c} - {RADIUS!r}e0) AS BIGINT) + {int(2 * RADIUS)})")
    (ul, uh), (vl, vh) = cut("u", "w"), cut("v", "h")
    return with_sql(
        "sp",
        f", {_PATHS}, {top}, {ext}, ask AS (SELECT event_id AS pt_id, CASE event_id % 3 WHEN 0 THEN 'xy' WHEN 1 THEN 'xz' ELSE 'yz' END AS plane, CAST(event_id // 3 % 100 AS INT) AS slice, event_id * 7 % 1000 / 10e0 AS u, user_id * 13 % 1000 / 10e0 AS v FROM events),\n"
        f"box AS (SELECT pt_id, plane, slice, {ul} AS ul, {uh} AS uh, {vl} AS vl, {vh} AS vh, w, h FROM ask JOIN ex USING (plane)), rk AS (SELECT plane, slice, path_id, CAST(row_number() OVER (PARTITION BY plane, slice ORDER BY path_id) - 1 AS BIGINT) * 18 AS rec FROM (SELECT DISTINCT plane, slice, path_id FROM pts))\n"
        f"SELECT DISTINCT pt_id, plane, slice, rec FROM box JOIN ln USING (plane, slice) JOIN rk USING (plane, slice, path_id) WHERE ul < uh AND vl < vh AND " + " AND ".join(f"floor(least({c}0, {c}1) / {CELL_SIDE}) <= floor({c}h / {CELL_SIDE}) AND floor(greatest({c}0, {c}1) / {CELL_SIDE}) >= floor({c}l / {CELL_SIDE})" for c in "uv"),
    )


def _found(s, d):
    return pt.paths_at(pt.slice_buckets(s, _slices(s, d)), _asked(s, d), RADIUS)


QUERIES = {
    "s17_path_steps": (
        lambda s, d: _lines(s, d).groupBy("plane", "slice").agg(F.count_distinct("rec").alias("n_paths"), F.count("*").alias("n"), *(F.sum(c).cast("long").alias(c) for c in ("u0", "v0", "u1", "v1", "pu", "pv", "nu", "nv"))),
        with_sql("sp", f", {_PATHS} SELECT plane, slice, count(DISTINCT path_id) AS n_paths, count(*) AS n, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("u0", "v0", "u1", "v1", "pu", "pv", "nu", "nv")) + " FROM ln GROUP BY 1, 2"),
    ),
    "s17_paths_about_points": (_found, _found_sql()),
    "i4_align_term": (lambda s, d: re.alignment(_tenth(s, d), _lines(s, d)).select("seg_id", "j", "i", "turn", "plane", "n", _scaled("align_term", 5)), _align_sql()),
}
