"""Queries of adjacent wraps, donors and folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.derive import query_points, surface_points, voxels, with_sql
from lamina.operators import folds as fo
from lamina.operators import solve as so
from lamina.operators import stencil as st
from lamina.operators import wraps as wr
from lamina.plans.points import _O4, _scaled, _sqls
from lamina.plans.surfaces import QUAD, WIDE, _wide
from lamina.plans.volumes import DISTANCE

GAP, ROUNDS = 10, 3
#: Sheets ten voxels apart: what of these layers is bright.
SHEETS = "v >= 100 AND z % 10 = 3"


def _inside(s, d):
    """The surfaces, scaled into the volume's box."""
    return surface_points(s, d).select("seg_id", "j", "i", (F.col("x") / 32).alias("x"), ((F.col("y") - 200 * F.col("seg_id")) / 7).alias("y"), (F.col("z") / 64).alias("z"))


def _distance(s, d):
    return st.distance_transform(voxels(s, d).where(SHEETS), (32, 32, 32)).select("z", "y", "x", F.sqrt("d2").alias("v"))


def _wrap_sql() -> str:
    far = "r.{0} - l.{0}", "d.{0} - t.{0}"
    u, v = ([f.format(c) for c in "xyz"] for f in far)
    n = [f"(({u[a]}) * ({v[b]}) - ({u[b]}) * ({v[a]}))" for a, b in ((1, 2), (2, 0), (0, 1))]
    join = lambda name, dj, di: f"JOIN s0 {name} ON {name}.seg_id = p.seg_id AND {name}.j = p.j + {dj} AND {name}.i = p.i + {di}"
    out = [
        "s0 AS MATERIALIZED (SELECT seg_id, j, i, x / 32 AS x, (y - 200 * seg_id) / 7 AS y, z / 64 AS z FROM (" + _SP + "))",
        f"nn AS (SELECT p.*, {', '.join(f'{e} AS m{c}' for e, c in zip(n, 'xyz', strict=True))} FROM s0 p {join('r', 0, 1)} {join('l', 0, -1)} {join('d', 1, 0)} {join('t', -1, 0)})",
        "ray AS MATERIALIZED (SELECT seg_id, j, i, x, y, z, mx / l AS nx, my / l AS ny, mz / l AS nz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS l FROM nn) WHERE l >= 1e-9)",
        f"pt AS MATERIALIZED (SELECT * FROM (SELECT seg_id, j, i, step, x + step * nx AS x, y + step * ny AS y, z + step * nz AS z FROM ray, (SELECT unnest(range(1, {int(wr.RAY * GAP)} + 1)) AS step)) WHERE x BETWEEN 0 AND 31 AND y BETWEEN 0 AND 31 AND z BETWEEN 0 AND 31)",
        "tap AS (SELECT p.*, CAST(floor(p.x) AS INT) + dx AS ix, CAST(floor(p.y) AS INT) + dy AS iy, CAST(floor(p.z) AS INT) + dz AS iz, abs(1 - dx - (x - floor(x))) * abs(1 - dy - (y - floor(y))) * abs(1 - dz - (z - floor(z))) AS w FROM pt p, (VALUES (0), (1)) a(dz), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dx))",
        "val AS MATERIALIZED (SELECT pt.seg_id, pt.j, pt.i, pt.step, coalesce(value, 0) AS dv FROM pt LEFT JOIN (SELECT seg_id, j, i, step, sum(w * sqrt(d2)) AS value FROM tap JOIN dt ON dt.z = iz AND dt.y = iy AND dt.x = ix GROUP BY 1, 2, 3, 4) USING (seg_id, j, i, step))",
        f"st AS (SELECT *, lag(dv, 1, 1e30) OVER w AS prev, lag(dv, 2, 1e30) OVER w AS before, bool_or(dv > {max(wr.CLEAR_SHARE * GAP, wr.LEAST_CLEAR)}) OVER w AS gone FROM val WINDOW w AS (PARTITION BY seg_id, j, i ORDER BY step))",
        f"hit AS (SELECT seg_id, j, i, min(step) - 1 AS hs FROM st WHERE gone AND before > prev AND dv >= prev AND prev < {wr.ON_SHEET} GROUP BY 1, 2, 3)",
        "o0 AS MATERIALIZED (SELECT seg_id, j, i, hs * nx AS ox, hs * ny AS oy, hs * nz AS oz, 1 AS kind FROM ray JOIN hit USING (seg_id, j, i) WHERE hs > 0)",
        _O4,
    ]
    for k in range(ROUNDS):
        out.append(f"o{k + 1} AS MATERIALIZED (SELECT * FROM o{k} UNION ALL SELECT c.seg_id, c.j, c.i, avg(ox), avg(oy), avg(oz), 3 FROM s0 c, o JOIN o{k} b ON b.seg_id = c.seg_id AND b.j = c.j + dj AND b.i = c.i + di"
                   f" WHERE NOT EXISTS (SELECT 1 FROM o{k} e WHERE e.seg_id = c.seg_id AND e.j = c.j AND e.i = c.i) GROUP BY c.seg_id, c.j, c.i HAVING count(*) >= 2)")
    return DISTANCE.replace("v >= 240", SHEETS) + ", " + ", ".join(out) + f" SELECT seg_id, j, i, kind, {', '.join(_sqls(f's0.{c} + o{c}', c, 4) for c in 'xyz')} FROM s0 JOIN o{ROUNDS} USING (seg_id, j, i)"


_SP = with_sql("sp", "")[len("WITH sp AS (") :].rstrip().removesuffix(")")

#: Cells of a surface near the donors: every point moved, and every tenth row doubled back on the one before.
_MOVED = {"x": "x + 6", "y": "y + 3", "z": "z + 4"}


def _cells(s, d):
    back = F.when(F.col("i") % 10 == 9, F.col("x") - 160).otherwise(F.col("x"))
    return surface_points(s, d).withColumn("x", back).select("seg_id", "j", "i", *(F.expr(e).alias(c) for c, e in _MOVED.items()), ((F.col("i") + F.col("z") % 7 * 3) / 25.0).alias("wind"))


def _donors(s, d):
    return surface_points(s, d).where("seg_id % 2 = 0 or i > 20").select("seg_id", "j", "i", "x", "y", "z", (F.col("i") / 25.0 + F.col("seg_id")).alias("wind"))


def _closest(p: str, a: str, b: str, c: str) -> str:
    """(d2, share of b - a, share of c - a) of the nearest point of a triangle, as a struct in SQL."""
    d = lambda u, v: " + ".join(f"({x}) * ({y})" for x, y in zip(u, v, strict=True))
    v = lambda u, w: [f"{w}{k} - {u}{k}" for k in "xyz"]
    ab, ac, ap, bc, bp = v(a, b), v(a, c), v(a, p), v(b, c), v(b, p)
    share = lambda u, w: f"CASE WHEN {d(u, u)} > 0 THEN least(1, greatest(0, ({d(w, u)}) / ({d(u, u)}))) ELSE 0 END"
    det = f"(({d(ab, ab)}) * ({d(ac, ac)}) - ({d(ab, ac)}) * ({d(ab, ac)}))"
    s, t = f"((({d(ac, ac)}) * ({d(ab, ap)}) - ({d(ab, ac)}) * ({d(ac, ap)})) / {det})", f"((({d(ab, ab)}) * ({d(ac, ap)}) - ({d(ab, ac)}) * ({d(ab, ap)})) / {det})"
    at = lambda x, y: "{'d2': " + " + ".join(f"pow({m} - ({x}) * ({n}) - ({y}) * ({o}), 2)" for m, n, o in zip(ap, ab, ac, strict=True)) + f", 'x': {x}, 'y': {y}}}"
    t0, t1, t2 = share(ab, ap), share(ac, ap), share(bc, bp)
    return f"CASE WHEN {det} > 1e-18 AND {s} >= 0 AND {t} >= 0 AND {s} + {t} <= 1 THEN {at(s, t)} ELSE list_min([{at(t0, '0e0')}, {at('0e0', t1)}, {at(f'1 - ({t2})', t2)}]) END"


def _fused_sql() -> str:
    near = " AND ".join(f"w.{c} BETWEEN least(p{c}, q{c}, r{c}, s{c}) - 8 AND greatest(p{c}, q{c}, r{c}, s{c}) + 8" for c in "xyz")
    w = lambda e: e.replace("sp ", "dn ").replace("FROM sp", "FROM dn").replace("JOIN sp", "JOIN dn")
    mix = lambda c: f"(1 - (v - y0)) * ((1 - (u - x0)) * a.{c} + (u - x0) * b.{c}) + (v - y0) * ((1 - (u - x0)) * c.{c} + (u - x0) * d.{c})"
    corner = lambda n, dj, di: f"JOIN dn {n} ON {n}.seg_id = m.donor AND {n}.j = y0 + {dj} AND {n}.i = x0 + {di}"
    return with_sql(
        "sp",
        f""", dn AS MATERIALIZED (SELECT *, i / 25e0 + seg_id AS wind FROM sp WHERE seg_id % 2 = 0 OR i > 20),
cl AS MATERIALIZED (SELECT seg_id, j, i, (CASE WHEN i % 10 = 9 THEN x - 160 ELSE x END) + 6 AS x, y + 3 AS y, z + 4 AS z, (i + z % 7 * 3) / 25e0 AS wind FROM sp),
{w(QUAD)}, pr AS MATERIALIZED (SELECT w.seg_id AS cs, w.j AS cj, w.i AS ci, w.x AS wx, w.y AS wy, w.z AS wz, quad.* FROM cl w JOIN quad ON {near}),
pl AS (SELECT cs, cj, ci, seg_id, j, i, {_closest('w', 'p', 'q', 'r')} AS a, {_closest('w', 's', 'r', 'q')} AS b FROM pr),
bs AS (SELECT cs, cj, ci, seg_id, j, i, least(a.d2, b.d2) AS d2, CASE WHEN a.d2 <= b.d2 THEN a.x ELSE 1 - b.x END AS fx, CASE WHEN a.d2 <= b.d2 THEN a.y ELSE 1 - b.y END AS fy FROM pl),
own AS MATERIALIZED (SELECT cs AS seg_id, cj AS j, ci AS i, seg_id AS donor, i + fx AS u, j + fy AS v FROM (SELECT *, row_number() OVER (PARTITION BY cs, cj, ci ORDER BY d2, seg_id, j, i) AS n FROM bs WHERE d2 <= 64) x WHERE n = 1),
{_O4}, fo AS (SELECT DISTINCT a.seg_id, a.j, a.i FROM own a, o JOIN own b ON b.seg_id = a.seg_id AND b.j = a.j + dj AND b.i = a.i + di WHERE a.donor = b.donor AND (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) > 16),
m AS MATERIALIZED (SELECT cl.seg_id, cl.j, cl.i, cl.wind, CAST(CASE WHEN own.donor IS NULL THEN -1 WHEN fo.seg_id IS NOT NULL THEN -2 ELSE own.donor END AS INT) AS donor, u, v, CAST(floor(u) AS INT) AS x0, CAST(floor(v) AS INT) AS y0
 FROM cl LEFT JOIN own USING (seg_id, j, i) LEFT JOIN fo USING (seg_id, j, i)),
bl AS MATERIALIZED (SELECT m.seg_id, m.j, m.i, m.donor, m.wind, {mix('x')} AS dx, {mix('y')} AS dy, {mix('z')} AS dz, {mix('wind')} AS dwind FROM m {corner('a', 0, 0)} {corner('b', 0, 1)} {corner('c', 1, 0)} {corner('d', 1, 1)}),
off AS (SELECT donor, list_sort(list(wind - dwind))[count(*) // 2 + 1] AS shift FROM bl GROUP BY 1)
SELECT m.seg_id, m.j, m.i, m.donor, {_sqls('m.u', 'u', 4)}, {_sqls('m.v', 'v', 4)}, {_sqls('dx', 'dx', 3)}, {_sqls('dy', 'dy', 3)}, {_sqls('dz', 'dz', 3)}, abs(bl.wind - dwind - shift) <= 0.3 AS agrees
 FROM m LEFT JOIN bl USING (seg_id, j, i) LEFT JOIN off ON off.donor = m.donor""",
    )


QUERIES = {
    "i9_adjacent_wrap": (
        lambda s, d: wr.adjacent_wrap(_inside(s, d), _distance(s, d), (32, 32, 32), F.lit(float(GAP)), 1, ROUNDS).select("seg_id", "j", "i", "kind", *(_scaled(c, 4) for c in "xyz")),
        _wrap_sql(),
    ),
    "i18_donor_fusion": (
        lambda s, d: wr.fused(_cells(s, d), _donors(s, d)).select("seg_id", "j", "i", "donor", *(_scaled(c, 4) for c in "uv"), *(_scaled("d" + c, 3) for c in "xyz"), "agrees"),
        _fused_sql(),
    ),
}


STEP, PASSES = 2.0, 3


def _grown(s, d):
    """Surfaces that turn back halfway and lie on themselves, with a ripple: generations by column, two anchors a row."""
    sp = surface_points(s, d)
    there = F.when(F.col("i") < 25, F.col("i")).otherwise(50 - F.col("i"))
    x = 2.0 * there + F.when(F.col("z") % 13 == 0, -5).otherwise(0)
    z = F.when(F.col("i") < 25, 0.0).otherwise(1.5) + F.col("x") % 5 / 8
    return sp.select("seg_id", "j", "i", x.alias("x"), (2.0 * F.col("j")).alias("y"), z.alias("z"), (F.expr("i div 5") + 1).cast("int").alias("gen"), (F.col("y") % 4 / 4).alias("conf"), (F.col("i") % 20 == 12).alias("anchor"))


def _folds_sql() -> str:
    out = [
        "c0 AS MATERIALIZED (SELECT seg_id, j, i, 2e0 * CASE WHEN i < 25 THEN i ELSE 50 - i END + CASE WHEN z % 13 = 0 THEN -5 ELSE 0 END AS x, 2e0 * j AS y, CASE WHEN i < 25 THEN 0e0 ELSE 1.5e0 END + x % 5 / 8 AS z,"
        " i // 5 + 1 AS gen, y % 4 / 4 AS conf, i % 20 = 12 AS anchor FROM sp)"
    ]
    now, step = "c0", 0
    d = lambda a, b: " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz")
    for _ in range(PASSES):
        turns = " UNION ALL ".join(
            f"SELECT p.seg_id, p.j AS fj, p.i AS fi, {k} AS axis, q.j, q.i, q.gen, q.anchor, abs(q.j - p.j) + abs(q.i - p.i) + CASE WHEN q.j + q.i > p.j + p.i THEN 1 ELSE 0 END AS o FROM {now} p JOIN {now} a ON a.seg_id = p.seg_id AND a.j = p.j - {dj} AND a.i = p.i - {di}"
            f" JOIN {now} b ON b.seg_id = p.seg_id AND b.j = p.j + {dj} AND b.i = p.i + {di} JOIN {now} q ON q.seg_id = p.seg_id AND ((q.j = p.j AND q.i = p.i) OR (q.j = a.j AND q.i = a.i) OR (q.j = b.j AND q.i = b.i))"
            f" WHERE {d('p', 'a')} >= 1e-12 AND {d('b', 'p')} >= 1e-12 AND {' + '.join(f'(p.{c} - a.{c}) * (b.{c} - p.{c})' for c in 'xyz')} < 0"
            for k, (dj, di) in enumerate(((0, 1), (1, 0)))
        )
        out.append(f"v{step} AS MATERIALIZED (SELECT DISTINCT seg_id, j, i FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, fj, fi, axis ORDER BY gen DESC, o) AS n FROM ({turns}) WHERE NOT anchor) WHERE n = 1)")
        out.append(f"c{step + 1} AS MATERIALIZED (SELECT * FROM {now} c WHERE NOT EXISTS (SELECT 1 FROM v{step} v WHERE v.seg_id = c.seg_id AND v.j = c.j AND v.i = c.i))")
        now, step = f"c{step + 1}", step + 1
    for _ in range(PASSES):
        u, v = ([f"(coalesce({a}.{c}, p.{c}) - coalesce({b}.{c}, p.{c}))" for c in "xyz"] for a, b in (("r", "l"), ("d", "t")))
        m = [f"({u[a]} * {v[b]} - {u[b]} * {v[a]})" for a, b in ((1, 2), (2, 0), (0, 1))]
        side = " ".join(f"LEFT JOIN {now} {n} ON {n}.seg_id = p.seg_id AND {n}.j = p.j + {dj} AND {n}.i = p.i + {di}" for n, dj, di in (("r", 0, 1), ("l", 0, -1), ("d", 1, 0), ("t", -1, 0)))
        far = "greatest(abs(b.j - a.j), abs(b.i - a.i))"
        stop = lambda c: f"CASE WHEN s = 0 THEN {c}1 ELSE {c}1 + CAST(trunc((({c}2 - {c}1) * s + CASE WHEN {c}2 >= {c}1 THEN 1 ELSE -1 END * (n // 2)) / CAST(n AS DOUBLE)) AS INT) END"
        reach = 4.0
        out += [
            f"n{step} AS MATERIALIZED (SELECT * EXCLUDE (mx, my, mz), mx / sqrt(mx * mx + my * my + mz * mz) AS nx, my / sqrt(mx * mx + my * my + mz * mz) AS ny, mz / sqrt(mx * mx + my * my + mz * mz) AS nz FROM (SELECT p.*, {m[0]} AS mx, {m[1]} AS my, {m[2]} AS mz FROM {now} p {side}"
            " WHERE (r.i IS NOT NULL OR l.i IS NOT NULL) AND (d.i IS NOT NULL OR t.i IS NOT NULL)) WHERE sqrt(mx * mx + my * my + mz * mz) > 1e-12)",
            f"p{step} AS MATERIALIZED (SELECT a.seg_id, a.j AS j1, a.i AS i1, b.j AS j2, b.i AS i2, CAST({far} AS INT) AS n, sqrt({d('a', 'b')}) AS dd, a.gen AS g1, b.gen AS g2, a.conf AS f1, b.conf AS f2, a.anchor AS a1, b.anchor AS a2 FROM n{step} a JOIN n{step} b ON b.seg_id = a.seg_id AND (b.j > a.j OR (b.j = a.j AND b.i > a.i))"
            f" WHERE {far} >= 2 AND {far} * {STEP} >= {2 * reach} AND {d('a', 'b')} < {reach * reach} AND {' + '.join(f'a.n{c} * b.n{c}' for c in 'xyz')} < -0.3)",
            f"w{step} AS (SELECT seg_id, j1, i1, j2, i2, n, dd, s, {stop('j')} AS j, {stop('i')} AS i FROM (SELECT *, unnest(range(0, n + 1)) AS s FROM p{step} WHERE n * {STEP} <= 200))",
            f"l{step} AS (SELECT w.*, x, y, z, lag(x) OVER q AS px, lag(y) OVER q AS py, lag(z) OVER q AS pz FROM w{step} w JOIN {now} c USING (seg_id, j, i) WINDOW q AS (PARTITION BY seg_id, j1, i1, j2, i2 ORDER BY s))",
            f"k{step} AS (SELECT seg_id, j1, i1, j2, i2 FROM l{step} GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = any_value(n) + 1 AND sum(CASE WHEN s > 0 THEN sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) ELSE 0 END) >= 4 * any_value(dd) UNION ALL SELECT seg_id, j1, i1, j2, i2 FROM p{step} WHERE n * {STEP} > 200)",
            f"f{step} AS (SELECT *, CASE WHEN a1 THEN false WHEN a2 THEN true WHEN g1 <> g2 THEN g1 > g2 ELSE f1 <= f2 END AS one FROM p{step} JOIN k{step} USING (seg_id, j1, i1, j2, i2) WHERE NOT (a1 AND a2))",
            f"v{step} AS MATERIALIZED (SELECT DISTINCT seg_id, CASE WHEN one THEN j1 ELSE j2 END AS j, CASE WHEN one THEN i1 ELSE i2 END AS i FROM f{step})",
            f"c{step + 1} AS MATERIALIZED (SELECT * FROM {now} c WHERE NOT EXISTS (SELECT 1 FROM v{step} v WHERE v.seg_id = c.seg_id AND v.j = c.j AND v.i = c.i))",
        ]
        now, step = f"c{step + 1}", step + 1
    return with_sql("sp", "").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {', '.join(out)}, {_O4},
lost AS (SELECT seg_id FROM c0 GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM {now} x WHERE x.seg_id = c0.seg_id)),
able AS (SELECT DISTINCT seg_id FROM {now} WHERE (gen <= 1 OR anchor) AND seg_id IN (SELECT seg_id FROM lost)),
reach AS (SELECT seg_id, j, i FROM {now} WHERE gen <= 1 OR anchor UNION SELECT c.seg_id, c.j, c.i FROM reach r, o JOIN {now} c ON c.seg_id = r.seg_id AND c.j = r.j + dj AND c.i = r.i + di)
SELECT seg_id, j, i, 'kept' AS why FROM {now} c WHERE EXISTS (SELECT 1 FROM reach r WHERE r.seg_id = c.seg_id AND r.j = c.j AND r.i = c.i) OR seg_id NOT IN (SELECT seg_id FROM able)
UNION ALL SELECT seg_id, j, i, 'orphan' FROM {now} c WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.seg_id = c.seg_id AND r.j = c.j AND r.i = c.i) AND seg_id IN (SELECT seg_id FROM able)
UNION ALL {' UNION ALL '.join(f"SELECT seg_id, j, i, '{'crease' if k < PASSES else 'doubled'}' FROM v{k}" for k in range(2 * PASSES))}"""


def _excised(s, d):
    kept, gone = fo.excised(_grown(s, d), STEP, None, PASSES)
    return kept.select("seg_id", "j", "i", F.lit("kept").alias("why")).union(gone.select("seg_id", "j", "i", "why"))


QUERIES["i10_fold_arms"] = (_excised, _folds_sql())


RADIUS, FAR, PICK = 4, 60.0, 1.5


def _judged(s, d):
    """The surfaces with confidences and errors of winding from their positions."""
    return surface_points(s, d).withColumns({"conf": F.col("z") % 10 / 10 + 0.2, "werr": F.col("x") % 5 / 10})


_REOPENED = f"""c AS (SELECT seg_id, j, i, z % 10 / 10 + 0.2e0 AS conf, x % 5 / 10 AS werr, x, y, z FROM sp), {WIDE},
n AS (SELECT pt_id, c.seg_id, c.j, c.i, row_number() OVER (PARTITION BY pt_id ORDER BY (w.x - c.x) * (w.x - c.x) + (w.y - c.y) * (w.y - c.y) + (w.z - c.z) * (w.z - c.z), c.seg_id, c.j, c.i) AS k
 FROM wide w JOIN c ON (w.x - c.x) * (w.x - c.x) + (w.y - c.y) * (w.y - c.y) + (w.z - c.z) * (w.z - c.z) <= {FAR * FAR}),
ctr AS (SELECT DISTINCT seg_id, j AS cj, i AS ci FROM n WHERE k = 1), {_O4},
fl AS (SELECT seg_id, cj, ci, cj AS j, ci AS i FROM ctr UNION SELECT f.seg_id, f.cj, f.ci, c.j, c.i FROM fl f, o JOIN c ON c.seg_id = f.seg_id AND c.j = f.j + dj AND c.i = f.i + di
 WHERE greatest(abs(c.j - f.cj), abs(c.i - f.ci)) <= {RADIUS} AND (greatest(abs(c.j - f.cj), abs(c.i - f.ci)) <= 2 OR conf < 0.5 OR werr > 0.3)),
bad AS (SELECT DISTINCT seg_id, cj, ci FROM fl WHERE i <= 1 OR j <= 1 OR i >= 48 OR j >= 8)
SELECT DISTINCT seg_id, j, i FROM fl WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.seg_id = fl.seg_id AND bad.cj = fl.cj AND bad.ci = fl.ci)"""


def _picked_sql() -> str:
    """Moving least squares at every node, over the plane of x and y."""
    size = f"max(x) - min(x) AS wu, max(y) - min(y) AS wv, min(x) AS u0, min(y) AS v0, count(*) AS n, {PICK} AS size"
    k = "exp(-(p * p + q * q) / (2 * kn * kn))"
    sums = {"a": "k", "p": "k * p", "q": "k * q", "pp": "k * p * p", "pq": "k * p * q", "qq": "k * q * q", "b0": "k * z", "b1": "k * p * z", "b2": "k * q * z"}
    det = "(a * (pp * qq - pq * pq) - p * (p * qq - pq * q) + q * (p * pq - pp * q))"
    return with_sql(
        "qp",
        f""", b AS (SELECT *, CAST(least(1024, floor(wu / size) + 2) AS INT) AS w, CAST(least(1024, floor(wv / size) + 2) AS INT) AS h, greatest(3 * size, 1.5e0 * sqrt(greatest(1, wu * wv / n))) AS kn FROM (SELECT {size} FROM qp)),
nd AS MATERIALIZED (SELECT b.*, a.k AS i, c.k AS j, u0 + wu * a.k / (w - 1) AS gu, v0 + wv * c.k / (h - 1) AS gv FROM b, (SELECT unnest(range(0, 64)) AS k) a, (SELECT unnest(range(0, 64)) AS k) c WHERE a.k < w AND c.k < h),
pr AS (SELECT j, i, kn, gu, gv, x - gu AS p, y - gv AS q, z FROM nd JOIN qp ON (x - gu) * (x - gu) + (y - gv) * (y - gv) <= 9 * kn * kn),
s AS (SELECT j, i, any_value(gu) AS gu, any_value(gv) AS gv, {', '.join(f'sum({e}) AS {n}' for n, e in sums.items())} FROM (SELECT *, {k} AS k FROM pr) GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN abs({det}) > 1e-9 * (a + 1) THEN (b0 * (pp * qq - pq * pq) - p * (b1 * qq - pq * b2) + q * (b1 * pq - pp * b2)) / {det} ELSE b0 / a END AS z FROM s WHERE a >= 0.35e0)
SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, {_sqls('gu', 'x', 3)}, {_sqls('gv', 'y', 3)}, {_sqls('z', 'z', 3)} FROM f""",
    )


QUERIES |= {
    "i13_reopened": (lambda s, d: so.reopened(_judged(s, d), _wide(s, d), 10, 50, RADIUS, FAR), with_sql("sp qp", "").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _REOPENED),
    "i13_reoptimised": (lambda s, d: so.reoptimised(_judged(s, d), _wide(s, d), surface_points(s, d).where("z % 3 > 0"), 10, 50, 20.0, 12.0, RADIUS, FAR), None),
    "i21_picked_surface": (lambda s, d: so.picked_surface(query_points(s, d), (0.0, 0.0, 0.0), ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), PICK).select("j", "i", *(_scaled(c, 3) for c in "xyz")), _picked_sql()),
}
