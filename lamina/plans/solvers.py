"""Queries of solvers; what iterates over floating-point fits has no SQL and is tested by what must hold of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.derive import SQL, query_points, surface_points, voxels, with_sql
from lamina.operators import axis as ax
from lamina.operators import geometry as ge
from lamina.operators import iterate as it
from lamina.operators import quality as qu
from lamina.operators import sampling as sa
from lamina.operators import solve as so
from lamina.operators import stencil as st
from lamina.operators import surface as su
from lamina.plans.geometry import _tri
from lamina.plans.points import _GRID50, _O4, _T, _WRAP, THETA, _cells, _scaled, _sizes, _sqls
from lamina.plans.surfaces import _TURN, QUAD, WIDE, _len, _n, _wide
from lamina.plans.volumes import DISTANCE
from lamina.session import cut


def _growth(s, d):
    """From a patch in the middle of every segment over all surface points, as boundary points, until nothing is new."""
    sp = surface_points(s, d)
    mid = sp.groupBy("seg_id").agg(*(F.expr(f"(min({c}) + max({c})) div 2").alias("m" + c) for c in "ji"))
    seeds = sp.join(mid, "seg_id").where("j between mj - 1 and mj + 2 and i between mi - 2 and mi + 2")
    return so.grown(seeds, sp.select("x", "y", "z"), 10, 50, 10 * 50, 20.0, 12.0)


def _registration(s, d):
    v = voxels(s, d)
    m = so.registered(v, v, ((1.0, 0.0, 0.0, 0.3), (0.0, 1.0, 0.0, -0.2), (0.0, 0.0, 1.0, 0.1)), rounds=3)
    return s.createDataFrame([(k, *map(float, r)) for k, r in enumerate(m)], "row int, mx double, my double, mz double, m1 double")


KNOTS, DEEP = 3, 1200.0


def _rolled(s, d):
    """The surfaces rolled up: radius by place in the grid, with the points' own offsets as noise, and one in some thirteen far off."""
    theta, wind = F.col("i") / 8.0 - 3, F.col("j") % 4 + (F.col("i") / 8.0 - 3) / (2 * F.pi())
    rho = 40 + F.col("z") / 50 + 2 * F.cos(theta) - F.sin(2 * theta) + 12 * wind + F.col("x") % 20 / 10 + F.when(F.col("z") % 13 == 0, 30.0).otherwise(0.0)
    return surface_points(s, d).select(rho.alias("rho"), theta.alias("theta"), wind.alias("wind"), "z")


def _spiral_fit(s, d):
    got = ax.spiral_fit(cut(_rolled(s, d)), KNOTS, DEEP)
    values = [*got["r0"], *got["harmonics"], got["omega"], got["rms"]] if got else []
    return s.createDataFrame(list(enumerate(map(float, values))), "k int, value double").select("k", _scaled("value", 4))


def _spiral_sql(rounds=4):
    """Reweighted normal equations as rows, solved by elimination row by row."""
    n = KNOTS + 5
    hat = [f"CASE WHEN i0 = {k} THEN 1 - f WHEN i0 + 1 = {k} THEN f ELSE 0 END" for k in range(KNOTS)]
    phi = [*hat, "cos(theta)", "sin(theta)", "cos(2 * theta)", "sin(2 * theta)", "wind"]
    bend = [(-1, 2, -1)[k] if k < 3 else 0 for k in range(n)]
    out = [
        "g AS (SELECT i / 8e0 - 3 AS theta, j % 4 + (i / 8e0 - 3) / (2 * pi()) AS wind, x, z FROM sp)",
        "r AS (SELECT 40 + z / 50 + 2 * cos(theta) - sin(2 * theta) + 12 * wind + x % 20 / 10 + CASE WHEN z % 13 = 0 THEN 30 ELSE 0 END AS rho, theta, wind, z FROM g)",
        f"zc AS (SELECT *, least(greatest(z / {DEEP / (KNOTS - 1)!r}e0, 0), {KNOTS - 1}) AS zc FROM r WHERE rho >= 1e-9)",
        f"o AS (SELECT *, zc - i0 AS f FROM (SELECT *, least(floor(zc), {KNOTS - 2}) AS i0 FROM zc))",
        f"p AS MATERIALIZED (SELECT [{', '.join(f'CAST({e} AS DOUBLE)' for e in (*phi, 'rho'))}] AS p FROM o)",
    ]
    fitted = "(" + " + ".join(f"x[{k + 1}] * p[{k + 1}]" for k in range(n)) + ")"
    for s in range(rounds):
        weight = f"1 / (1 + pow((p[{n + 1}] - {fitted}) / (0.25e0 * abs(x[{n}])), 2))" if s else "1e0"
        out.append(f"w{s} AS MATERIALIZED (SELECT p, {weight} AS w FROM p" + (f", x{s - 1})" if s else ")"))
        out.append(f"t{s} AS (SELECT sum(w) AS total FROM w{s})")
        out.append(f"n{s} AS (SELECT a.k AS r, b.k AS c, sum(w * p[a.k] * p[b.k]) AS v FROM w{s}, (SELECT unnest(range(1, {n + 1})) AS k) a, (SELECT unnest(range(1, {n + 2})) AS k) b GROUP BY 1, 2)")
        out.append(f"m{s}_0 AS MATERIALIZED (SELECT r, c, v + CASE WHEN c <= {n} THEN 1e-2 * total / {KNOTS} * {bend}[r] * {bend}[c] ELSE 0 END + CASE WHEN r = c THEN 1e-6 * (total / {n} + 1) ELSE 0 END AS v FROM n{s}, t{s})")
        for k in range(1, n + 1):
            m = f"m{s}_{k - 1}"
            out.append(f"m{s}_{k} AS MATERIALIZED (SELECT m.r, m.c, CASE WHEN m.r = {k} THEN m.v / d.v ELSE m.v - a.v * b.v / d.v END AS v FROM {m} m JOIN {m} d ON d.r = {k} AND d.c = {k} JOIN {m} a ON a.r = m.r AND a.c = {k} JOIN {m} b ON b.r = {k} AND b.c = m.c)")
        out.append(f"x{s} AS MATERIALIZED (SELECT list(v ORDER BY r) AS x FROM m{s}_{n} WHERE c = {n + 1})")
    last = f"x{rounds - 1}"
    out.append(f"e AS (SELECT p[{n + 1}] - {fitted} AS e, x[{n}] AS omega FROM p, {last})")
    return with_sql("sp", f", {', '.join(out)}, a AS (SELECT unnest(range(0, {n})) AS k, unnest(x) AS value FROM {last} UNION ALL SELECT {n}, sqrt(avg(e * e)) FROM e WHERE abs(e) < 0.5e0 * abs(omega) + 1e-9) SELECT CAST(k AS INT) AS k, {_sqls('value', 'value', 4)} FROM a WHERE (SELECT count(*) FROM p) >= {ax.LEAST_OBSERVATIONS}")


def _embedding(s, d):
    """A sheared plane embedding of the surfaces, in eighths, so that sums are exact."""
    return surface_points(s, d).select("seg_id", "j", "i", (F.col("i") * 1.25 + F.col("j") * 0.25).alias("u"), (F.col("j") * 1.5).alias("v"), "x", "y", "z")


_TRI = """, e AS (SELECT seg_id, j, i, i * 1.25e0 + j * 0.25e0 AS u, j * 1.5e0 AS v, x, y, z FROM sp),
t AS (SELECT a.seg_id, a.j, a.i, 0 AS k, a.u AS au, a.v AS av, b.u AS bu, b.v AS bv, c.u AS cu, c.v AS cv, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
 FROM e a JOIN e b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i = a.i + 1 JOIN e c ON c.seg_id = a.seg_id AND c.j = a.j + 1 AND c.i = a.i
 UNION ALL SELECT c.seg_id, a.j, a.i - 1, 1, a.u, a.v, b.u, b.v, c.u, c.v, a.x, a.y, a.z, b.x, b.y, b.z, c.x, c.y, c.z
 FROM e a JOIN e b ON b.seg_id = a.seg_id AND b.j = a.j + 1 AND b.i = a.i JOIN e c ON c.seg_id = a.seg_id AND c.j = a.j + 1 AND c.i = a.i - 1),
l AS (SELECT *, unnest(range(CAST(ceil(least(au, bu, cu)) AS BIGINT), CAST(floor(greatest(au, bu, cu)) AS BIGINT) + 1)) AS lu FROM t),
m AS (SELECT *, unnest(range(CAST(ceil(least(av, bv, cv)) AS BIGINT), CAST(floor(greatest(av, bv, cv)) AS BIGINT) + 1)) AS lv FROM l),
w AS (SELECT *, (bu - au) * (cv - av) - (cu - au) * (bv - av) AS det, ((lu - au) * (cv - av) - (cu - au) * (lv - av)) / ((bu - au) * (cv - av) - (cu - au) * (bv - av)) AS w1,
 ((bu - au) * (lv - av) - (lu - au) * (bv - av)) / ((bu - au) * (cv - av) - (cu - au) * (bv - av)) AS w2 FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY seg_id, lv, lu ORDER BY j DESC, i DESC, k DESC) AS n FROM w WHERE w1 >= 0 AND w2 >= 0 AND w1 + w2 <= 1)
SELECT seg_id, lv, lu, """

def _fold_sql(passes):
    """At every fold the newest of the cell and its two neighbours on that axis goes, pass by pass."""
    from lamina.plans.surfaces import _TURN

    out = ["c0 AS MATERIALIZED (SELECT seg_id, j, i, x / 10 + z % 17 AS x, y, z, i AS gen FROM sp)"]
    for k in range(passes):
        turns = _TURN.replace("FROM sp p", f"FROM c{k} p").replace("JOIN sp a", f"JOIN c{k} a").replace("JOIN sp b", f"JOIN c{k} b")
        out.append(f"f{k} AS MATERIALIZED (SELECT seg_id, j, i, axis FROM ({turns}) WHERE cos < 0)")
        out.append(
            f"d{k} AS MATERIALIZED (SELECT DISTINCT seg_id, vj, vi FROM (SELECT f.seg_id, c.j AS vj, c.i AS vi, row_number() OVER (PARTITION BY f.seg_id, f.j, f.i, f.axis ORDER BY c.gen DESC, c.j DESC, c.i DESC) AS n"
            f" FROM f{k} f, (VALUES (0), (-1), (1)) o(m) JOIN c{k} c ON c.seg_id = f.seg_id AND c.j = f.j + CASE WHEN axis = 1 THEN m ELSE 0 END AND c.i = f.i + CASE WHEN axis = 0 THEN m ELSE 0 END) WHERE n = 1)"
        )
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT * FROM c{k} c WHERE NOT EXISTS (SELECT 1 FROM d{k} d WHERE d.seg_id = c.seg_id AND d.vj = c.j AND d.vi = c.i))")
    return with_sql("sp", f", {', '.join(out)} SELECT seg_id, j, i, x, y, z, gen FROM c{passes}")


def _potential_sql(rounds):
    """Conjugate gradients of the linked cells, round by round."""
    out = [
        THETA,
        _O4,
        f"l AS MATERIALIZED (SELECT a.seg_id, a.j, a.i, b.j AS nj, b.i AS ni, {_WRAP} AS turn FROM c a, o JOIN c b ON b.seg_id = a.seg_id AND b.j = a.j + dj AND b.i = a.i + di WHERE abs({_WRAP}) <= 0.25)",
        "b AS (SELECT seg_id, j, i, count(*) AS deg, sum(turn) AS b FROM l GROUP BY 1, 2, 3)",
        "s0 AS MATERIALIZED (SELECT c.seg_id, c.j, c.i, coalesce(deg, 0) AS deg, CAST(0 AS DOUBLE) AS x, coalesce(b, 0) AS r, coalesce(b, 0) AS p FROM c LEFT JOIN b USING (seg_id, j, i))",
        "e0 AS MATERIALIZED (SELECT seg_id, sum(r * r) AS rr FROM s0 GROUP BY 1)",
    ]
    for k in range(rounds):
        out.append(f"m{k} AS (SELECT l.seg_id, l.j, l.i, sum(n.p) AS near FROM l JOIN s{k} n ON n.seg_id = l.seg_id AND n.j = l.nj AND n.i = l.ni GROUP BY 1, 2, 3)")
        out.append(f"q{k} AS MATERIALIZED (SELECT s.*, deg * p - coalesce(near, 0) + 1e-9 * p AS q FROM s{k} s LEFT JOIN m{k} USING (seg_id, j, i))")
        out.append(f"a{k} AS MATERIALIZED (SELECT seg_id, any_value(rr) AS rr, CASE WHEN any_value(rr) > 1e-10 AND sum(p * q) > 0 THEN any_value(rr) / sum(p * q) ELSE 0 END AS a FROM q{k} JOIN e{k} USING (seg_id) GROUP BY 1)")
        out.append(f"t{k} AS MATERIALIZED (SELECT seg_id, j, i, deg, x + a * p AS x, r - a * q AS r, p, rr FROM q{k} JOIN a{k} USING (seg_id))")
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT seg_id, sum(r * r) AS rr FROM t{k} GROUP BY 1)")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT t.seg_id, j, i, deg, x, r, r + CASE WHEN t.rr > 0 THEN e.rr / t.rr ELSE 0 END * p AS p FROM t{k} t JOIN e{k + 1} e ON e.seg_id = t.seg_id)")
    return with_sql("sp", f", {', '.join(out)} SELECT seg_id, j, i, {_sqls('x - first_value(x) OVER (PARTITION BY seg_id ORDER BY j, i)', 'wind', 4)} FROM s{rounds}")


_QUALITY = with_sql("sp", "").replace("WITH ", "WITH RECURSIVE ", 1) + (
    f", {_GRID50}, e AS (SELECT * FROM cell WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.seg_id = cell.seg_id AND sp.j = cell.j AND sp.i = cell.i)), {_O4},"
    " reach AS (SELECT * FROM e WHERE i = 0 OR j = 0 OR i = 49 OR j = 9 UNION SELECT e.* FROM reach r, o JOIN e ON e.seg_id = r.seg_id AND e.j = r.j + dj AND e.i = r.i + di),"
    " h AS (SELECT seg_id, count(*) AS holes FROM (SELECT * FROM e EXCEPT SELECT * FROM reach) GROUP BY 1),"
    f" {QUAD}, turn AS ({_TURN}), k AS (SELECT seg_id, count(*) FILTER (cos < 0) AS folds, count(*) FILTER (cos >= 0 AND cos < 0.86602540378443864676e0) AS kinks,"
    " list_sort(list(CASE WHEN acos(least(1, greatest(-1, cos))) > 1e-4 THEN 40 / acos(least(1, greatest(-1, cos))) ELSE 1e30 END)) AS rad FROM turn GROUP BY 1),"
    " w AS (SELECT seg_id, sqrt(avg(pow((" + " + ".join(f"{n} * (s{c} - p{c})" for n, c in zip(_n("q", "p", "r", "p"), "xyz", strict=True)) + f") / {_len(_n('q', 'p', 'r', 'p'))}, 2))) AS twist,"
    f" sum(0.5 * ({_len(_n('q', 'p', 'r', 'p'))} + {_len(_n('s', 'q', 'r', 'q'))})) AS area, list_sort(list(abs(" + " + ".join(f"(q{c} - p{c}) * (r{c} - p{c})" for c in "xyz") + ") / (" + " + ".join(f"(q{c} - p{c}) * (q{c} - p{c})" for c in "xyz") + "))) AS sl FROM quad GROUP BY 1),"
    " f AS (SELECT seg_id, count(*) AS n, CAST((max(i) - min(i) + 1) * (max(j) - min(j) + 1) AS DOUBLE) AS box FROM sp GROUP BY 1)"
    f" SELECT seg_id, {_sqls('coalesce(area, 0)', 'area', 3)}, {_sqls('n / box', 'fill')}, {_sqls('coalesce(holes, 0) / box', 'hole')}, coalesce(folds, 0) AS folds, coalesce(kinks, 0) AS kinks, {_sqls('coalesce(twist, 0)', 'twist', 4)},"
    f" {_sqls('sl[len(sl) - len(sl) // 20]', 'slant_p95')}, {_sqls('rad[len(rad) // 20 + 1]', 'bend_p5', 3)}, {_sqls('rad[len(rad) // 2 + 1]', 'bend_median', 3)} FROM f LEFT JOIN k USING (seg_id) LEFT JOIN w USING (seg_id) LEFT JOIN h USING (seg_id)"
)
_NEAR = (
    f", {WIDE}, {QUAD}, c AS (SELECT pt_id, w.x AS wx, w.y AS wy, w.z AS wz, quad.* FROM wide w JOIN quad ON "
    + " AND ".join(f"w.{c} BETWEEN least(p{c}, q{c}, r{c}, s{c}) - 60 AND greatest(p{c}, q{c}, r{c}, s{c}) + 60" for c in "xyz")
    + f"), m AS (SELECT pt_id, min(least({_tri('w', 'p', 'q', 'r')}, {_tri('w', 's', 'r', 'q')})) AS d2 FROM c GROUP BY 1)"
)
_CONFIDENT = DISTANCE + (
    ", " + _T.format("qp") + f", sv AS (SELECT t.pt_id, sum(wx * wy * wz * d2) AS value FROM tap t JOIN dt ON dt.z = iz AND dt.y = iy AND dt.x = ix GROUP BY 1) SELECT pt_id, {_sqls('greatest(1 - least(sqrt(coalesce(value, 0)), 12) / 12, 0)', 'conf', 4)} FROM qp LEFT JOIN sv USING (pt_id)"
)

QUERIES = {
    "a18_quality_report": (
        lambda s, d: qu.report(surface_points(s, d), _sizes(s, d), 20.0).select("seg_id", _scaled("area", 3), _scaled("fill"), _scaled("hole"), "folds", "kinks", _scaled("twist", 4), _scaled("slant_p95"), _scaled("bend_p5", 3), _scaled("bend_median", 3)),
        _QUALITY,
    ),
    "g14_lattice_resample": (
        lambda s, d: so.lattice_resampled(_embedding(s, d)).select("seg_id", "lv", "lu", *(_scaled(c, 4) for c in "xyz")),
        with_sql("sp", _TRI + ", ".join(_sqls(f"a{c} + w1 * (b{c}{'_' if c == 'y' else ''} - a{c}) + w2 * (c{c} - a{c})", c, 4) for c in "xyz") + " FROM p WHERE n = 1"),
    ),
    "i2_i3_surface_growth": (_growth, None),
    "i6_spiral_fit": (_spiral_fit, _spiral_sql()),
    "i8_winding_potential": (lambda s, d: so.winding_potential(_cells(s, d), 6).select("seg_id", "j", "i", _scaled("wind", 4)), _potential_sql(6)),
    "i17_registration": (_registration, None),
    "i10_fold_excision": (lambda s, d: it.excised(surface_points(s, d).withColumns({"gen": F.col("i"), "x": F.col("x") / 10 + F.col("z") % 17}), su.bends), _fold_sql(16)),
    "a19_donor_agreement": (
        lambda s, d: so.donor_agreement(ge.nearest_surface(_wide(s, d), su.quads(surface_points(s, d)), 60.0), _wide(s, d).count()).select("n", *(_scaled(c, 4) for c in ("mean", "rms", "p95")), "coverage"),
        with_sql("sp qp", _NEAR + f", g AS (SELECT * FROM m WHERE d2 <= 3600), t AS (SELECT count(*) AS n, avg(sqrt(d2)) AS mean, sqrt(avg(d2)) AS rms, list_sort(list(d2)) AS l FROM g) SELECT n, {_sqls('mean', 'mean', 4)}, {_sqls('rms', 'rms', 4)}, {_sqls('sqrt(l[n - n // 20])', 'p95', 4)}, n / CAST((SELECT count(*) FROM wide) AS DOUBLE) AS coverage FROM t"),
    ),
    "i18_donor_offsets": (
        lambda s, d: so.donor_offsets(query_points(s, d).select((F.col("pt_id") % 7).alias("donor_id"), F.col("x").alias("cell_wind"), F.col("y").alias("donor_wind"))),
        with_sql("qp", ", m AS (SELECT pt_id % 7 AS donor_id, x - y AS d FROM qp), o AS (SELECT donor_id, list_sort(list(d))[count(*) // 2 + 1] AS \"offset\" FROM m GROUP BY 1) SELECT m.donor_id, o.\"offset\", count(*) FILTER (abs(d - o.\"offset\") <= 0.3) AS members FROM m JOIN o USING (donor_id) GROUP BY 1, 2"),
    ),
    "i5_distance_confidence": (
        lambda s, d: (lambda dt: sa.trilinear(query_points(s, d), dt.select("z", "y", "x", F.col("d2").alias("v"))).select("pt_id", F.floor(it.confidence(F.sqrt("value"), F.lit(0)) * 1e4 + 0.5).cast("long").alias("conf")))(st.distance_transform(voxels(s, d).where("v >= 240"), (32, 32, 32))),
        _CONFIDENT.replace("WITH ", "WITH qp AS (" + SQL["qp"] + "),\n", 1),
    ),
}
