"""Queries on the derived surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.derive import query_points, surface_points, voxels, with_sql
from lamina.operators import index as ix
from lamina.operators import surface as su
from lamina.operators.stats import ranked

TILE = 4
NORMAL = (0.25, 0.5, 1.0)
_AX = "xyz"

BOX = "box AS (SELECT seg_id, " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _AX) + ", count(*) AS nvalid FROM sp GROUP BY seg_id)"
_Q = {c: f"CASE WHEN {c}_hi > {c}_lo THEN ({c}_hi - {c}_lo) / 65535e0 ELSE 1e0 END" for c in _AX}
TILES = (
    BOX
    + f""", sent AS (SELECT *, unnest(range(greatest(i - 1, 0) // {TILE}, i // {TILE} + 1)) AS ti FROM (
 SELECT *, unnest(range(greatest(j - 1, 0) // {TILE}, j // {TILE} + 1)) AS tj FROM sp)),
tile AS (SELECT seg_id, CAST(tj AS INT) AS tj, CAST(ti AS INT) AS ti, """
    + ", ".join(f"CAST(least(65535, floor((min({c}) - any_value({c}_lo)) / any_value({_Q[c]}))) AS INT) AS lo_{c}" for c in _AX)
    + ", "
    + ", ".join(f"CAST(least(65535, ceil((max({c}) - any_value({c}_lo)) / any_value({_Q[c]}))) AS INT) AS hi_{c}" for c in _AX)
    + " FROM sent JOIN box USING (seg_id) GROUP BY 1, 2, 3)"
)
BOXES = TILES + ", tb AS (SELECT seg_id, tj, ti, " + ", ".join(f"{c}_lo + ({_Q[c]}) * lo_{c} AS t{c}0, {c}_lo + ({_Q[c]}) * hi_{c} AS t{c}1, {c}_lo AS s{c}0, {c}_hi AS s{c}1" for c in _AX) + " FROM tile JOIN box USING (seg_id))"
QUAD = (
    "quad AS (SELECT a.seg_id, a.j, a.i, "
    + ", ".join(f"{p}.{c} AS {n}{c}" for p, n in (("a", "p"), ("b", "q"), ("d", "r"), ("e", "s")) for c in _AX)
    + " FROM sp a JOIN sp b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i = a.i + 1 JOIN sp d ON d.seg_id = a.seg_id AND d.j = a.j + 1 AND d.i = a.i JOIN sp e ON e.seg_id = a.seg_id AND e.j = a.j + 1 AND e.i = a.i + 1)"
)  # p00 p, p10 q, p01 r, p11 s


def _n(u: str, a: str, v: str, b: str) -> list[str]:
    """Cross product of (u - a) and (v - b)."""
    d = [(f"({u}{c} - {a}{c})", f"({v}{c} - {b}{c})") for c in _AX]
    return [f"({d[k][0]} * {d[m][1]} - {d[m][0]} * {d[k][1]})" for k, m in ((1, 2), (2, 0), (0, 1))]


def _len(v: list[str]) -> str:
    return "sqrt(" + " + ".join(f"{x} * {x}" for x in v) + ")"


def _scaled(col: str, digits: int) -> F.Column:
    return F.floor(F.col(col) * 10**digits + 0.5).cast("long").alias(col)


def _sqls(expr: str, digits: int, name: str) -> str:
    return f"CAST(floor(({expr}) * {10**digits} + 0.5) AS BIGINT) AS {name}"


def _wide(s, d):
    """Query positions spread over the surfaces' space."""
    return query_points(s, d).select("pt_id", (F.col("x") * 32).alias("x"), (F.col("y") * 26).alias("y"), (F.col("z") * 32 + 50).alias("z"))


WIDE = "wide AS (SELECT pt_id, x * 32 AS x, y * 26 AS y, z * 32 + 50 AS z FROM qp)"


def _boxes(s, d):
    sp = surface_points(s, d)
    return su.tile_boxes(su.tiles(sp, TILE), su.bounds(sp))


def _range(p: str) -> tuple[str, str]:
    return tuple(" + ".join(f"{n} * {p}{c}{k}" for c, n in zip(_AX, NORMAL, strict=True)) for k in (0, 1))


_TURN = " UNION ALL ".join(
    f"SELECT p.seg_id, p.j, p.i, {k} AS axis, ({' + '.join(f'(p.{c} - a.{c}) * (b.{c} - p.{c})' for c in _AX)}) / sqrt(({' + '.join(f'(p.{c} - a.{c}) * (p.{c} - a.{c})' for c in _AX)}) * ({' + '.join(f'(b.{c} - p.{c}) * (b.{c} - p.{c})' for c in _AX)})) AS cos"
    f" FROM sp p JOIN sp a ON a.seg_id = p.seg_id AND a.j = p.j{dj[0]} AND a.i = p.i{di[0]} JOIN sp b ON b.seg_id = p.seg_id AND b.j = p.j{dj[1]} AND b.i = p.i{di[1]}"
    for k, dj, di in ((0, ("", ""), (" - 1", " + 1")), (1, (" - 1", " + 1"), ("", "")))
)
_RING = "pqsr"
_F = [" + ".join(f"{p}{c} * {n}" for c, n in zip(_AX, NORMAL, strict=True)) + " - 350" for p in _RING]
_GI, _GJ = (0, 1, 1, 0), (0, 0, 1, 1)


def _edge(e: int) -> str:
    a, b = e, (e + 1) % 4
    t = f"CASE WHEN f{a} = f{b} THEN 0.5e0 ELSE f{a} / (f{a} - f{b}) END"
    mix = lambda u, v: f"({u}) + (({v}) - ({u})) * ({t})"
    cols = [mix(f"i + {_GI[a]}", f"i + {_GI[b]}"), mix(f"j + {_GJ[a]}", f"j + {_GJ[b]}"), *(mix(f"{_RING[a]}{c}", f"{_RING[b]}{c}") for c in _AX)]
    return f"SELECT seg_id, j, i, cs, {e} AS e, " + ", ".join(f"{x} AS {n}" for x, n in zip(cols, ("gi", "gj", *_AX), strict=True)) + " FROM f"


_CASES = ", ".join(f"({k}, {n // 2}, {c[n]}, {c[n + 1]})" for k, c in enumerate(su.CASES) for n in range(0, len(c), 2))

MATRIX = ((1.0, 0.25, 0.0, 5.0), (-0.5, 1.0, 0.5, -3.0), (0.0, 0.125, 2.0, 7.0))

QUERIES = {
    "a7_segment_bounds": (lambda s, d: su.bounds(surface_points(s, d)), with_sql("sp", f", {BOX} SELECT * FROM box")),
    "a8_tile_index": (lambda s, d: su.tiles(surface_points(s, d), TILE), with_sql("sp", f", {TILES} SELECT * FROM tile")),
    "a9_row_zone_maps": (
        lambda s, d: su.row_bounds(surface_points(s, d)),
        with_sql("sp", "SELECT seg_id, j, " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _AX) + " FROM sp GROUP BY 1, 2"),
    ),
    "s16_decimated_surface": (lambda s, d: su.decimate(surface_points(s, d), 2), with_sql("sp", "SELECT seg_id, CAST(j // 2 AS INT) AS j, CAST(i // 2 AS INT) AS i, x, y, z FROM sp WHERE i % 2 = 0 AND j % 2 = 0")),
    "f7_valid_points": (lambda s, d: surface_points(s, d), with_sql("sp", "SELECT * FROM sp")),
    "f14_untorn_cells": (
        lambda s, d: su.untorn(surface_points(s, d), 20.0),
        with_sql(
            "sp",
            ", o(dj, di) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)), t AS (SELECT DISTINCT p.seg_id, p.j, p.i FROM sp p, o JOIN sp n ON n.seg_id = p.seg_id AND n.j = p.j + dj AND n.i = p.i + di WHERE "
            + " + ".join(f"(n.{c} - p.{c}) * (n.{c} - p.{c})" for c in _AX)
            + " > 1225) SELECT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.seg_id = sp.seg_id AND t.j = sp.j AND t.i = sp.i)",
        ),
    ),
    "g5_g6_affine_surface": (
        lambda s, d: su.transformed(surface_points(s, d), MATRIX),
        with_sql("sp", "SELECT seg_id, j, i, " + ", ".join(f"{r[0]} * x + {r[1]} * y + {r[2]} * z + {r[3]} AS {c}" for r, c in zip([[f"{v!r}e0" for v in r] for r in MATRIX], _AX, strict=True)) + " FROM sp"),
    ),
    "g6_spacing": (
        lambda s, d: su.spacing(surface_points(s, d)).select("seg_id", _scaled("spacing", 6)),
        with_sql("sp", ", t AS (SELECT a.seg_id, list_sort(list(sqrt(" + " + ".join(f"(b.{c} - a.{c}) * (b.{c} - a.{c})" for c in _AX) + "))) AS l FROM sp a JOIN sp b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i = a.i + 1 GROUP BY 1) SELECT seg_id, " + _sqls("l[len(l) // 2 + 1]", 6, "spacing") + " FROM t"),
    ),
    "g7_bilinear_points": (
        lambda s, d: su.bilinear(surface_points(s, d), surface_points(s, d).select("seg_id", (F.col("i") + 0.25).alias("u"), (F.col("j") + 0.75).alias("v"))),
        with_sql("sp", f", {QUAD} SELECT seg_id, i + 0.25e0 AS u, j + 0.75e0 AS v, " + ", ".join(f"0.25e0 * (0.75e0 * p{c} + 0.25e0 * q{c}) + 0.75e0 * (0.75e0 * r{c} + 0.25e0 * s{c}) AS {c}" for c in _AX) + " FROM quad"),
    ),
    "g8_normals": (
        lambda s, d: su.normals(surface_points(s, d)).select("seg_id", "j", "i", *(_scaled("n" + c, 6) for c in _AX)),
        with_sql(
            "sp",
            ", n AS (SELECT p.seg_id, p.j, p.i, "
            + ", ".join(f"coalesce(r.{c}, p.{c}) - coalesce(l.{c}, p.{c}) AS u{c}, coalesce(d.{c}, p.{c}) - coalesce(t.{c}, p.{c}) AS v{c}" for c in _AX)
            + " FROM sp p LEFT JOIN sp r ON r.seg_id = p.seg_id AND r.j = p.j AND r.i = p.i + 1 LEFT JOIN sp l ON l.seg_id = p.seg_id AND l.j = p.j AND l.i = p.i - 1"
            + " LEFT JOIN sp d ON d.seg_id = p.seg_id AND d.j = p.j + 1 AND d.i = p.i LEFT JOIN sp t ON t.seg_id = p.seg_id AND t.j = p.j - 1 AND t.i = p.i"
            + " WHERE (r.i IS NOT NULL OR l.i IS NOT NULL) AND (d.i IS NOT NULL OR t.i IS NOT NULL)),"
            + " m AS (SELECT *, uy * vz - uz * vy AS mx, uz * vx - ux * vz AS my, ux * vy - uy * vx AS mz FROM n), k AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS s FROM m)"
            + " SELECT seg_id, j, i, " + ", ".join(_sqls(f"m{c} / s", 6, f"n{c}") for c in _AX) + " FROM k WHERE s > 1e-12",
        ),
    ),
    "a17_surface_area": (
        lambda s, d: su.area(surface_points(s, d)).select("seg_id", _scaled("area", 3), "n_quads"),
        with_sql("sp", f", {QUAD} SELECT seg_id, " + _sqls(f"sum(0.5 * ({_len(_n('q', 'p', 'r', 'p'))} + {_len(_n('s', 'q', 'r', 'q'))}))", 3, "area") + ", count(*) AS n_quads FROM quad GROUP BY 1"),
    ),
    "a18_mesh_quality": (
        lambda s, d: su.mesh_quality(surface_points(s, d)).select("seg_id", _scaled("fill", 6), "folds", "kinks", _scaled("twist2", 4)),
        with_sql(
            "sp",
            f", {QUAD}, t AS ({_TURN}), b AS (SELECT seg_id, count(*) FILTER (cos < 0) AS folds, count(*) FILTER (cos >= 0 AND cos < 0.8) AS kinks FROM t GROUP BY 1),"
            + " w AS (SELECT seg_id, avg(pow((" + " + ".join(f"{n} * (s{c} - p{c})" for n, c in zip(_n("q", "p", "r", "p"), _AX, strict=True)) + f") / {_len(_n('q', 'p', 'r', 'p'))}, 2)) AS twist2 FROM quad GROUP BY 1),"
            + " f AS (SELECT seg_id, count(*) / CAST((max(i) - min(i) + 1) * (max(j) - min(j) + 1) AS DOUBLE) AS fill FROM sp GROUP BY 1)"
            + f" SELECT seg_id, {_sqls('fill', 6, 'fill')}, coalesce(folds, 0) AS folds, coalesce(kinks, 0) AS kinks, {_sqls('twist2', 4, 'twist2')} FROM f LEFT JOIN b USING (seg_id) LEFT JOIN w USING (seg_id)",
        ),
    ),
    "a14_slant_p95": (
        lambda s, d: ranked(su.slant(surface_points(s, d)), ["seg_id"], "slant", "n - 1 - n div 20").select("seg_id", F.floor(F.col("slant") * 1e6 + 0.5).cast("long").alias("slant_p95")),
        with_sql(
            "sp",
            f", {QUAD}, t AS (SELECT seg_id, list_sort(list(abs(" + " + ".join(f"(q{c} - p{c}) * (r{c} - p{c})" for c in _AX) + ") / (" + " + ".join(f"(q{c} - p{c}) * (q{c} - p{c})" for c in _AX) + "))) AS l FROM quad GROUP BY 1) SELECT seg_id, " + _sqls("l[len(l) - len(l) // 20]", 6, "slant_p95") + " FROM t",
        ),
    ),
    "a18_bend_turns": (lambda s, d: su.bends(surface_points(s, d), 2).select("seg_id", "j", "i", "axis", _scaled("cos", 6)), with_sql("sp", f", t AS ({_TURN.replace(' - 1', ' - 2').replace(' + 1', ' + 2')}) SELECT seg_id, j, i, axis, " + _sqls("cos", 6, "cos") + " FROM t")),
    "r9_plane_trace": (
        lambda s, d: su.plane_trace(surface_points(s, d), NORMAL, 350.0).select("seg_id", "j", "i", "part", *(_scaled(f"{e}_{c}", 5) for e in "ab" for c in ("gi", "gj", *_AX))),
        with_sql(
            "sp",
            f", {QUAD}, f0 AS (SELECT *, " + ", ".join(f"{x} AS f{k}" for k, x in enumerate(_F)) + " FROM quad), f AS (SELECT *, " + " + ".join(f"CASE WHEN f{k} > 0 THEN {1 << k} ELSE 0 END" for k in range(4)) + " AS cs FROM f0),"
            + " e AS (" + " UNION ALL ".join(_edge(e) for e in range(4)) + f"), c(cs, part, a, b) AS (VALUES {_CASES})"
            + " SELECT f.seg_id, f.j, f.i, c.part, " + ", ".join(_sqls(f"{e}.{c}", 5, f"{n}_{c}") for e, n in (("ea", "a"), ("eb", "b")) for c in ("gi", "gj", *_AX))
            + " FROM f JOIN c ON c.cs = f.cs JOIN e ea ON ea.seg_id = f.seg_id AND ea.j = f.j AND ea.i = f.i AND ea.e = c.a JOIN e eb ON eb.seg_id = f.seg_id AND eb.j = f.j AND eb.i = f.i AND eb.e = c.b",
        ),
    ),
    "r10_stretch": (
        lambda s, d: su.stretch(surface_points(s, d), 20.0).select("seg_id", "j", "i", _scaled("stretch", 6)),
        with_sql(
            "sp",
            "SELECT p.seg_id, p.j, p.i, "
            + _sqls("greatest(-1, least(1, log2((sqrt(" + " + ".join(f"(r.{c} - p.{c}) * (r.{c} - p.{c})" for c in _AX) + ") + sqrt(" + " + ".join(f"(d.{c} - p.{c}) * (d.{c} - p.{c})" for c in _AX) + ")) / 2 / 20)))", 6, "stretch")
            + " FROM sp p JOIN sp r ON r.seg_id = p.seg_id AND r.j = p.j AND r.i = p.i + 1 JOIN sp d ON d.seg_id = p.seg_id AND d.j = p.j + 1 AND d.i = p.i",
        ),
    ),
    "i12_subdivide": (
        lambda s, d: su.subdivide(surface_points(s, d)),
        with_sql(
            "sp",
            f", {QUAD} SELECT seg_id, j * 2 AS j, i * 2 AS i, x, y, z FROM sp UNION ALL SELECT a.seg_id, a.j * 2, a.i * 2 + 1, (a.x + b.x) / 2, (a.y + b.y) / 2, (a.z + b.z) / 2 FROM sp a JOIN sp b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i = a.i + 1"
            + " UNION ALL SELECT a.seg_id, a.j * 2 + 1, a.i * 2, (a.x + b.x) / 2, (a.y + b.y) / 2, (a.z + b.z) / 2 FROM sp a JOIN sp b ON b.seg_id = a.seg_id AND b.i = a.i AND b.j = a.j + 1"
            + " UNION ALL SELECT seg_id, j * 2 + 1, i * 2 + 1, " + ", ".join(f"(p{c} + q{c} + r{c} + s{c}) / 4" for c in _AX) + " FROM quad",
        ),
    ),
    "j2_plane_query": (
        lambda s, d: ix.plane_query(_boxes(s, d), NORMAL, 350.0, 1.0, (100, 0, 60), (800, 700, 1200)),
        with_sql(
            "sp",
            f", {BOXES} SELECT seg_id, count(*) AS n_tiles FROM tb WHERE "
            + " AND ".join(f"{_range(p)[0]} - 1 <= 350 AND {_range(p)[1]} + 1 >= 350" for p in "st")
            + "".join(f" AND {p}{c}1 >= {a} AND {p}{c}0 <= {b}" for p in "st" for c, a, b in zip(_AX, (100, 0, 60), (800, 700, 1200), strict=True))
            + " GROUP BY seg_id",
        ),
    ),
    "j3_near_query": (
        lambda s, d: ix.near_query(_boxes(s, d), (500.0, 400.0, 500.0), 600.0, 3).select("seg_id", _scaled("d2", 4), "hits"),
        with_sql(
            "sp",
            f", {BOXES}, n AS (SELECT seg_id, min(" + " + ".join(f"pow(greatest(t{c}0 - {p}, {p} - t{c}1, 0), 2)" for c, p in zip(_AX, (500, 400, 500), strict=True)) + ") AS d2 FROM tb GROUP BY 1)"
            + " SELECT seg_id, " + _sqls("d2", 4, "d2") + ", (SELECT count(*) FROM n WHERE d2 <= 360000) AS hits FROM n WHERE d2 <= 360000 ORDER BY n.d2, seg_id LIMIT 3",
        ),
    ),
    "j4_segment_overlap": (
        lambda s, d: ix.overlap(_boxes(s, d), 60.0).select("a", "b", _scaled("overlap", 6)),
        with_sql(
            "sp",
            f", {BOXES}, p AS (SELECT a.seg_id AS a, b.seg_id AS b, "
            + ", ".join(f"greatest(a.{c}_lo, b.{c}_lo) - 60 AS {c}0, (least(a.{c}_hi, b.{c}_hi) + 60 - (greatest(a.{c}_lo, b.{c}_lo) - 60)) / 64 AS {c}s" for c in _AX)
            + " FROM box a JOIN box b ON a.seg_id <> b.seg_id WHERE " + " AND ".join(f"greatest(a.{c}_lo, b.{c}_lo) - 60 < least(a.{c}_hi, b.{c}_hi) + 60" for c in _AX) + "),"
            + " r AS (SELECT a, b, " + ", ".join(f"greatest(0, floor((t{c}0 - 60 - {c}0) / {c}s)) AS {c}a, least(63, floor((t{c}1 + 60 - {c}0) / {c}s)) AS {c}b" for c in _AX) + " FROM p JOIN tb ON tb.seg_id = p.b),"
            + " c AS (SELECT p.a, p.b, " + ", ".join(f"floor((0.5 * (t{c}0 + t{c}1) - {c}0) / {c}s) AS {c}k" for c in _AX) + " FROM p JOIN tb ON tb.seg_id = p.a)"
            + " SELECT a, b, " + _sqls("count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.a = c.a AND r.b = c.b" + "".join(f" AND {c}k >= {c}a AND {c}k <= {c}b" for c in _AX) + ")) / CAST(count(*) AS DOUBLE)", 6, "overlap") + " FROM c GROUP BY a, b",
        ),
    ),
    "j7_nearest_vertex": (
        lambda s, d: ix.nearest(_wide(s, d), surface_points(s, d), 100.0),
        with_sql(
            "sp qp",
            f", {WIDE}, c AS (SELECT pt_id, " + " + ".join(f"pow(w.{c} - s.{c}, 2)" for c in _AX) + " AS d2, seg_id, j, i FROM wide w JOIN sp s ON " + " AND ".join(f"s.{c} BETWEEN w.{c} - 100 AND w.{c} + 100" for c in _AX) + " WHERE s.i % 2 = 0 AND s.j % 2 = 0)"
            + " SELECT pt_id, d2, seg_id, j, i FROM (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY d2, seg_id, j, i) AS n FROM c WHERE d2 <= 10000) WHERE n = 1",
        ),
    ),
    "j6_support_count": (
        lambda s, d: ix.support(_wide(s, d), surface_points(s, d), 150.0),
        with_sql("sp qp", f", {WIDE} SELECT pt_id, count(DISTINCT seg_id) AS n FROM wide w JOIN sp s ON " + " AND ".join(f"s.{c} BETWEEN w.{c} - 150 AND w.{c} + 150" for c in _AX) + " WHERE " + " + ".join(f"pow(w.{c} - s.{c}, 2)" for c in _AX) + " <= 22500 GROUP BY 1"),
    ),
    "j8_self_overlap": (
        lambda s, d: ix.self_overlap(surface_points(s, d).select("seg_id", "j", "i", (F.col("x") / 16).alias("x"), (F.col("y") / 16).alias("y"), (F.col("z") / 16).alias("z")), 14.0),
        with_sql(
            "sp",
            ", q AS (SELECT seg_id, j, i, x / 16 AS x, y / 16 AS y, z / 16 AS z FROM sp), c AS (SELECT a.seg_id, a.j, a.i, " + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in _AX) + " AS d2, b.j AS j2, b.i AS i2 FROM q a JOIN q b ON a.seg_id = b.seg_id WHERE abs(a.i - b.i) > 8 OR abs(a.j - b.j) > 8)"
            + " SELECT seg_id, j, i, d2, j2, i2 FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, j, i ORDER BY d2, j2, i2) AS n FROM c WHERE d2 <= 196) WHERE n = 1",
        ),
    ),
    "j13_line_distance": (
        lambda s, d: ix.line_distance(
            _wide(s, d), su.around(surface_points(s, d), {"p": (0, 0), "r": (0, 1)}).where("p is not null and r is not null").select(F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("r.x").alias("x1"), F.col("r.y").alias("y1")), 32.0
        ).select("pt_id", _scaled("d2", 6)),
        with_sql(
            "sp qp",
            f", {WIDE}, l AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM sp a JOIN sp b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i = a.i + 1),"
            + " t AS (SELECT pt_id, x, y, l.*, CASE WHEN pow(x1 - x0, 2) + pow(y1 - y0, 2) > 0 THEN least(1, greatest(0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) ELSE 0 END AS t"
            + " FROM wide w JOIN l ON w.x BETWEEN least(x0, x1) - 32 AND greatest(x0, x1) + 32 AND w.y BETWEEN least(y0, y1) - 32 AND greatest(y0, y1) + 32),"
            + " m AS (SELECT pt_id, min(pow(x - (x0 + t * (x1 - x0)), 2) + pow(y - (y0 + t * (y1 - y0)), 2)) AS d2 FROM t GROUP BY 1) SELECT pt_id, " + _sqls("d2", 6, "d2") + " FROM m WHERE d2 <= 1024",
        ),
    ),
    "s13_j11_missing_chunks": (
        lambda s, d: ix.missing(query_points(s, d).select(*(F.floor(F.col(c) / 2).cast("int").alias(c) for c in _AX)), voxels(s, d).where("v > 245").select(*(F.expr(f"{c} div 2").cast("int").alias(c) for c in _AX)), list(_AX)),
        with_sql("qp voxel", "SELECT CAST(floor(x / 2) AS INT) AS x, CAST(floor(y / 2) AS INT) AS y, CAST(floor(z / 2) AS INT) AS z FROM qp EXCEPT SELECT CAST(x // 2 AS INT), CAST(y // 2 AS INT), CAST(z // 2 AS INT) FROM voxel WHERE v > 245"),
    ),
    "r13_t2_request_budget": (
        lambda s, d: ix.ray_priority(query_points(s, d).select((F.col("pt_id") % 3).alias("priority"), (F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("d2"), "pt_id"), 256),
        with_sql("qp", "SELECT pt_id % 3 AS priority, x * x + y * y AS d2, pt_id FROM qp ORDER BY 1, 2, 3 LIMIT 256"),
    ),
}
