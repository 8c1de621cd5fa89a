"""The flattening query, with its rounds and steps written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.derive import surface_points, with_sql
from lamina.operators import flatten as fl
from lamina.plans.points import _scaled, _sqls
from lamina.plans.surfaces import QUAD

STEP, ROUNDS, STEPS = 20.0, 2, 3
_AT = {0: ("pqr", ((0, 0), (0, 1), (1, 0))), 1: ("qsr", ((0, 1), (1, 1), (1, 0)))}


def _rest() -> str:
    parts = []
    for k, ((a, b, c), at) in _AT.items():
        one = [[f"({p}{x} - {a}{x})" for x in "xyz"] for p in (b, c)]
        d = lambda u, v: " + ".join(f"{m} * {n}" for m, n in zip(u, v, strict=True))
        places = ", ".join(f"j + {dj} AS j{n}, i + {di} AS i{n}" for n, (dj, di) in zip("abc", at, strict=True))
        parts.append(f"SELECT seg_id, j, i, {k} AS k, {places}, sqrt({d(one[0], one[0])}) AS l1, {d(one[0], one[1])} AS d12, {d(one[1], one[1])} AS l2 FROM quad")
    lengths = f"SELECT *, d12 / l1 AS px, l2 - (d12 / l1) * (d12 / l1) AS py2 FROM ({' UNION ALL '.join(parts)})"
    return f"rest AS MATERIALIZED (SELECT *, sqrt(py2) / (l1 * sqrt(py2)) AS b0, -px / (l1 * sqrt(py2)) AS b1, l1 / (l1 * sqrt(py2)) AS b3, 0.5e0 * (l1 * sqrt(py2)) AS area FROM ({lengths}) WHERE l1 >= 1e-9 AND py2 >= 1e-12)"


def _corners(table: str, columns: str) -> str:
    """Triangles with these columns of their corners."""
    names = ", ".join(f"{n}.{c} AS {n}{c}" for n in "abc" for c in columns.split())
    key = lambda t, n="": f"(CAST({t}.seg_id AS BIGINT) * 1000003 + {t}.j{n}) * 1000003 + {t}.i{n}"  # noqa: E731  (one value, so that no corners are joined by segment alone)
    joins = " ".join(f"JOIN {table} {n} ON {key(n)} = {key('t', n)}" for n in "abc")
    return f"SELECT t.*, {names} FROM rest t {joins}"


def _jacobian(u: str, v: str, name: str) -> str:
    d = lambda p, c: f"({p}{c} - a{c})"
    return f"{d('b', u)} * b0 AS {name}0, {d('b', u)} * b1 + {d('c', u)} * b3 AS {name}1, {d('b', v)} * b0 AS {name}2, {d('b', v)} * b1 + {d('c', v)} * b3 AS {name}3"


def _product(m: str, rows: str, u: str, v: str) -> str:
    return f"(SELECT m.seg_id, m.nj AS j, m.ni AS i, sum(w00 * {u} + w01 * {v}) AS qu, sum(w01 * {u} + w11 * {v}) AS qv FROM {m} m JOIN {rows} x ON x.seg_id = m.seg_id AND x.j = m.j AND x.i = m.i GROUP BY 1, 2, 3)"


def _round(r: int) -> list[str]:
    f = lambda s: f"CASE WHEN abs(greatest({s}, 1e-4) - 1) < 1e-8 THEN 4 ELSE greatest((greatest({s}, 1e-4) - 1 / (greatest({s}, 1e-4) * greatest({s}, 1e-4) * greatest({s}, 1e-4))) / (greatest({s}, 1e-4) - 1), 1e-8) END"
    g = [("(-b0)", "(-b1 - b3)"), ("b0", "b1"), ("0e0", "b3")]
    out = [
        f"ja{r} AS (SELECT *, {_jacobian('u', 'v', 'j_')} FROM ({_corners(f'v{r}', 'u v')}))",
        f"sv{r} AS (SELECT *, sqrt((j_0 + j_3) * (j_0 + j_3) + (j_2 - j_1) * (j_2 - j_1)) / 2 AS h1, sqrt((j_0 - j_3) * (j_0 - j_3) + (j_1 + j_2) * (j_1 + j_2)) / 2 AS h2 FROM ja{r})",
        f"y{r} AS (SELECT *, {f('(h1 + h2)')} AS y0, {f('(h1 - h2)')} AS y1 FROM sv{r})",
        f"tl{r} AS (SELECT *, CASE WHEN 2 * h1 * h2 > 1e-12 THEN (y0 - y1) / 2 / (2 * h1 * h2) ELSE 0 END AS tilt, (j_0 * j_0 + j_1 * j_1 - j_2 * j_2 - j_3 * j_3) / 2 AS skew, (j_0 + j_3) / (2 * h1) AS c, (j_2 - j_1) / (2 * h1) AS sn FROM y{r})",
        f"w{r} AS (SELECT *, area * ((y0 + y1) / 2 + tilt * skew) AS x00, area * tilt * (j_0 * j_2 + j_1 * j_3) AS x01, area * ((y0 + y1) / 2 - tilt * skew) AS x11 FROM tl{r})",
        f"r{r} AS MATERIALIZED (SELECT *, x00 * c + x01 * sn AS r0, x01 * c - x00 * sn AS r1, x01 * c + x11 * sn AS r2, x11 * c - x01 * sn AS r3 FROM w{r})",
    ]
    pairs = " UNION ALL ".join(f"SELECT seg_id, j{a} AS j, i{a} AS i, j{b} AS nj, i{b} AS ni, ({g[x][0]} * {g[y][0]} + {g[x][1]} * {g[y][1]}) * x00 AS w00, ({g[x][0]} * {g[y][0]} + {g[x][1]} * {g[y][1]}) * x01 AS w01, ({g[x][0]} * {g[y][0]} + {g[x][1]} * {g[y][1]}) * x11 AS w11 FROM r{r}" for x, a in enumerate("abc") for y, b in enumerate("abc"))
    right = " UNION ALL ".join(f"SELECT seg_id, j{a} AS j, i{a} AS i, r0 * {g[x][0]} + r1 * {g[x][1]} AS bu, r2 * {g[x][0]} + r3 * {g[x][1]} AS bv FROM r{r}" for x, a in enumerate("abc"))
    out += [
        f"m{r} AS MATERIALIZED (SELECT seg_id, j, i, nj, ni, sum(w00) AS w00, sum(w01) AS w01, sum(w11) AS w11 FROM ({pairs}) GROUP BY 1, 2, 3, 4, 5)",
        f"b{r} AS MATERIALIZED (SELECT seg_id, j, i, sum(bu) AS bu, sum(bv) AS bv FROM ({right}) GROUP BY 1, 2, 3)",
        f"tol{r} AS MATERIALIZED (SELECT seg_id, sum(bu * bu + bv * bv) * 1e-10 + 1e-30 AS tol FROM b{r} GROUP BY 1)",
        f"s{r}_0 AS MATERIALIZED (SELECT seg_id, j, i, u, v, 1e-12 + m.w00 AS du, 1e-12 + m.w11 AS dv, u AS su, v AS sv, bu - qu AS ru, bv - qv AS rv, 0e0 AS pu, 0e0 AS pv, 0e0 AS gu, 0e0 AS gv"
        f" FROM v{r} JOIN b{r} USING (seg_id, j, i) JOIN {_product(f'm{r}', f'v{r}', 'u', 'v')} q USING (seg_id, j, i) JOIN (SELECT * FROM m{r} WHERE nj = j AND ni = i) m USING (seg_id, j, i))",
        f"l{r}_0 AS (SELECT seg_id, tol, 0e0 AS gamma, 0e0 AS alpha, 0e0 AS beta, true AS is_on FROM tol{r})",
    ]
    for k in range(STEPS):
        s = f"{r}_{k}"
        beta = "0e0" if not k else "CASE WHEN gamma > 0 THEN g / gamma ELSE 0 END"
        out += [
            f"z{s} AS MATERIALIZED (SELECT *, ru / du AS zu, rv / dv AS zv FROM s{s})",
            f"q{s} AS MATERIALIZED (SELECT z.*, qu, qv FROM z{s} z JOIN {_product(f'm{r}', f'z{s}', 'zu', 'zv')} USING (seg_id, j, i))",
            f"d{s} AS (SELECT seg_id, sum(ru * zu + rv * zv) AS g, sum(qu * zu + qv * zv) AS d, sum(ru * ru + rv * rv) AS rr FROM q{s} GROUP BY 1)",
            f"be{s} AS (SELECT seg_id, tol, alpha, g, d, rr, is_on, {beta} AS beta FROM l{s} JOIN d{s} USING (seg_id))",
            f"un{s} AS (SELECT *, d - CASE WHEN alpha > 0 THEN beta * g / alpha ELSE 0 END AS un FROM be{s})",
            f"l{r}_{k + 1} AS MATERIALIZED (SELECT seg_id, tol, g AS gamma, CASE WHEN is_on AND rr >= tol AND un > 0 THEN g / un ELSE 0 END AS alpha, CASE WHEN is_on AND rr >= tol AND un > 0 THEN beta ELSE 0 END AS beta, is_on AND rr >= tol AND un > 0 AS is_on FROM un{s})",
            f"n{s} AS (SELECT q.*, alpha, zu + beta * pu AS npu, zv + beta * pv AS npv, qu + beta * gu AS ngu, qv + beta * gv AS ngv FROM q{s} q JOIN l{r}_{k + 1} USING (seg_id))",
            f"s{r}_{k + 1} AS MATERIALIZED (SELECT seg_id, j, i, u, v, du, dv, su + alpha * npu AS su, sv + alpha * npv AS sv, ru - alpha * ngu AS ru, rv - alpha * ngv AS rv, npu AS pu, npv AS pv, ngu AS gu, ngv AS gv FROM n{s})",
        ]
    n, det = lambda t: f"(jj + 2 * {t} * jd + {t} * {t} * dd)", lambda t: f"(c0 + {t} * c1 + {t} * {t} * c2)"
    energy = lambda t: f"sum(CASE WHEN {det(t)} <= 0 OR (sqrt(greatest({n(t)} + 2 * {det(t)}, 0)) - sqrt(greatest({n(t)} - 2 * {det(t)}, 0))) / 2 < 1e-4 THEN 1e30 ELSE area * {n(t)} * (1 + 1 / ({det(t)} * {det(t)})) END)"
    tries = ", ".join(f"{energy(f'(t * {0.5**k!r})')} AS e{k}" for k in range(fl.HALVINGS))
    terms = ", ".join(f"{e} AS {c}" for c, e in (("jj", "j_0 * j_0 + j_1 * j_1 + j_2 * j_2 + j_3 * j_3"), ("jd", "j_0 * d_0 + j_1 * d_1 + j_2 * d_2 + j_3 * d_3"), ("dd", "d_0 * d_0 + d_1 * d_1 + d_2 * d_2 + d_3 * d_3"), ("c0", "j_0 * j_3 - j_1 * j_2"), ("c1", "j_0 * d_3 + d_0 * j_3 - j_1 * d_2 - d_1 * j_2"), ("c2", "d_0 * d_3 - d_1 * d_2")))
    root = "list_min(list_filter([CASE WHEN abs(c2) < 1e-14 AND abs(c1) > 1e-14 THEN -c0 / c1 END, CASE WHEN abs(c2) >= 1e-14 AND c1 * c1 - 4 * c2 * c0 >= 0 THEN (-c1 - sqrt(c1 * c1 - 4 * c2 * c0)) / (2 * c2) END, CASE WHEN abs(c2) >= 1e-14 AND c1 * c1 - 4 * c2 * c0 >= 0 THEN (-c1 + sqrt(c1 * c1 - 4 * c2 * c0)) / (2 * c2) END], lambda x: x > 1e-12))"
    first = "coalesce(" + ", ".join(f"CASE WHEN e{k} < e THEN t * {0.5**k!r} END" for k in range(fl.HALVINGS)) + ", 0)"
    after = "coalesce(" + ", ".join(f"CASE WHEN e{k} < e THEN e{k} END" for k in range(fl.HALVINGS)) + ", e)"
    halted = f"done{r - 1}" if r else "false"
    out += [
        f"dir{r} AS (SELECT seg_id, j, i, u, v, su - u AS pu, sv - v AS pv FROM s{r}_{STEPS})",
        f"t{r} AS (SELECT *, {_jacobian('u', 'v', 'j_')}, {_jacobian('pu', 'pv', 'd_')} FROM ({_corners(f'dir{r}', 'u v pu pv')}))",
        f"c{r} AS MATERIALIZED (SELECT seg_id, area, {terms} FROM t{r})",
        f"lim{r} AS MATERIALIZED (SELECT seg_id, sum(area) AS alls, {energy('0e0')} AS e, least(1, coalesce(0.8e0 * min({root}), 1)) AS t FROM c{r} GROUP BY 1)",
        f"tri{r} AS MATERIALIZED (SELECT seg_id, {tries} FROM c{r} JOIN (SELECT seg_id, t FROM lim{r}) USING (seg_id) GROUP BY 1)",
        f"ch{r} AS (SELECT seg_id, alls, e, {first} AS t, {after} AS en FROM lim{r} JOIN tri{r} USING (seg_id))",
        f"st{r} AS MATERIALIZED (SELECT ch.seg_id, CASE WHEN {halted} THEN 0 ELSE ch.t END AS t, {halted} OR ch.t = 0 OR (e - en) / alls / (e / alls - 4 + 1e-12) < 1e-4 AS done{r} FROM ch{r} ch{f' JOIN st{r - 1} USING (seg_id)' if r else ''})",
        f"v{r + 1} AS MATERIALIZED (SELECT seg_id, j, i, u + t * pu AS u, v + t * pv AS v FROM dir{r} JOIN (SELECT seg_id, t FROM st{r}) USING (seg_id))",
    ]
    return out


def _sql() -> str:
    places = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dj, di)"
    whole = [QUAD, _rest(), f"v0 AS MATERIALIZED (SELECT DISTINCT seg_id, j + dj AS j, i + di AS i, CAST((i + di) * {STEP} AS DOUBLE) AS u, CAST((j + dj) * {STEP} AS DOUBLE) AS v FROM rest, {places})"]
    for r in range(ROUNDS):
        whole += _round(r)
    least = f"SELECT seg_id, min(u) AS lu, min(v) AS lv FROM v{ROUNDS} GROUP BY 1"
    return with_sql("sp", f", {', '.join(whole)} SELECT seg_id, CAST(j AS INT) AS j, CAST(i AS INT) AS i, {_sqls('u - lu', 'u', 3)}, {_sqls('v - lv', 'v', 3)} FROM v{ROUNDS} JOIN ({least}) USING (seg_id)")


QUERIES = {
    "i16_flatten": (
        lambda s, d: fl.flattened(surface_points(s, d), STEP, ROUNDS, STEPS)[0].select("seg_id", F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"), _scaled("u", 3), _scaled("v", 3)),
        _sql(),
    ),
}
