"""Queries on the derived volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions.derive import grown_side, grown_voxels, sided_voxels, voxels, with_sql
from lamina.operators import stencil as st
from lamina.operators import volume as vo
from lamina.session import cut

SHAPE = (32, 32, 32)
OFF27 = "off AS (SELECT CAST(a.k AS INT) AS dz, CAST(b.k AS INT) AS dy, CAST(c.k AS INT) AS dx FROM (SELECT unnest(range(-1, 2)) AS k) a, (SELECT unnest(range(-1, 2)) AS k) b, (SELECT unnest(range(-1, 2)) AS k) c)"


def _off(r: int) -> str:
    return OFF27.replace("range(-1, 2)", f"range({-r}, {r + 1})")


def _clamp(r: int, body: str) -> str:
    """Dense voxels joined with their clamped neighbours as ``nb(z, y, x, v, u)``, then ``body``."""
    near = lambda c: f"greatest(0, least(31, a.{c} + d{c}))"
    return with_sql("voxel grid dense", f""", {_off(r)}, place AS (SELECT a.z, a.y, a.x, a.v, {near('z')} AS nz, {near('y')} AS ny, {near('x')} AS nx FROM dense a, off),
nb AS (SELECT a.z, a.y, a.x, a.v, b.v AS u FROM place a JOIN dense b ON b.z = a.nz AND b.y = a.ny AND b.x = a.nx)\n{body}""")


POINTS = [(0, 0, 0, 0, 0), (40, 10, 20, 30, 0), (128, 128, 64, 32, 90), (255, 255, 255, 255, 255)]
_TF = " UNION ALL ".join(
    f"SELECT CAST(k AS INT) AS v, " + ", ".join(f"CAST(({p[j + 1]} * ({q[0]} - k) + {q[j + 1]} * (k - {p[0]})) // {q[0] - p[0]} AS INT) AS {c}" for j, c in enumerate("rgba")) + f" FROM (SELECT unnest(range({p[0]}, {q[0]})) AS k)"
    for p, q in zip(POINTS, POINTS[1:], strict=False)
) + f" UNION ALL SELECT 255, {', '.join(str(x) for x in POINTS[-1][1:])}"

#: Distances within 16 of each block of 16, from one axis to the next; where no voxel is in reach, 255.
DISTANCE = with_sql(
    "voxel grid",
    """, s AS (SELECT z, y, x FROM voxel WHERE v >= 240),
a AS (SELECT g.z, g.y, g.x, min((g.x - s.x) * (g.x - s.x)) AS d FROM grid g JOIN s ON s.z = g.z AND s.y = g.y GROUP BY 1, 2, 3),
b AS (SELECT g.z, g.y, g.x, min(a.d + (g.y - a.y) * (g.y - a.y)) AS d FROM grid g JOIN a ON a.z = g.z AND a.x = g.x GROUP BY 1, 2, 3),
dt AS (SELECT g.z, g.y, g.x, CAST(least(255, coalesce(min(b.d + (g.z - b.z) * (g.z - b.z)), 255)) AS INT) AS d2 FROM grid g LEFT JOIN b ON b.y = g.y AND b.x = g.x GROUP BY 1, 2, 3)
""",
)



def _grown_hysteresis(s, d):
    """The table is read once: strong voxels are the brightest of the weak ones."""
    n = grown_side(s, d)
    weak = cut(sided_voxels(s, d, n).where("v >= 170"))
    return st.hysteresis(weak.where("v >= 225"), weak, (n,) * 3)


QUERIES = {
    "a1_pyramid_mean": (
        lambda s, d: vo.pyramid_mean(voxels(s, d)),
        with_sql("voxel", "SELECT CAST(z // 2 AS INT) AS z, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST((sum(v) + 4) // 8 AS INT) AS v FROM voxel GROUP BY 1, 2, 3"),
    ),
    "a2_pyramid_truncated": (
        lambda s, d: vo.pyramid(voxels(s, d), 2, rounded=False),
        with_sql(
            "voxel",
            """, l1 AS (SELECT CAST(z // 2 AS INT) AS z, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(sum(v) // 8 AS INT) AS v FROM voxel GROUP BY 1, 2, 3)
SELECT 1 AS level, * FROM l1 UNION ALL SELECT 2, CAST(z // 2 AS INT), CAST(y // 2 AS INT), CAST(x // 2 AS INT), CAST(sum(v) // 8 AS INT) FROM l1 GROUP BY 2, 3, 4""",
        ),
    ),
    "a3_gradient_mean": (
        lambda s, d: vo.gradient_weighted_mean(voxels(s, d), SHAPE),
        with_sql(
            "voxel grid dense",
            """, g AS (SELECT a.z // 2 AS bz, a.y // 2 AS by_, a.x // 2 AS bx, CAST(a.v AS DOUBLE) AS v,
 1 + sqrt(pow(b.v - a.v, 2) + pow(c.v - a.v, 2) + pow(e.v - a.v, 2)) * (9.0e0 / 255) AS w, a.z % 2 * 4 + a.y % 2 * 2 + a.x % 2 AS o
 FROM dense a JOIN dense b ON b.z = a.z + 1 - 2 * (a.z % 2) AND b.y = a.y AND b.x = a.x JOIN dense c ON c.z = a.z AND c.y = a.y + 1 - 2 * (a.y % 2) AND c.x = a.x
 JOIN dense e ON e.z = a.z AND e.y = a.y AND e.x = a.x + 1 - 2 * (a.x % 2))
SELECT CAST(bz AS INT) AS z, CAST(by_ AS INT) AS y, CAST(bx AS INT) AS x, CAST(floor(sum(w * v ORDER BY o) / sum(w ORDER BY o) + 0.5) AS INT) AS v FROM g GROUP BY 1, 2, 3""",
        ),
    ),
    "a4_plane_mean": (
        lambda s, d: vo.plane_mean(voxels(s, d), 4),
        with_sql("voxel", "SELECT z, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, CAST(sum(v) // count(*) AS INT) AS v FROM voxel GROUP BY 1, 2, 3"),
    ),
    "a5_occupancy_dilated": (
        lambda s, d: st.occupancy(voxels(s, d), 8, (4, 4, 4)).where("v > 0"),
        with_sql(
            "voxel",
            f""", b AS (SELECT z // 8 AS z, y // 8 AS y, x // 8 AS x, max(v) AS v FROM voxel GROUP BY 1, 2, 3), {OFF27}
SELECT CAST(z + dz AS INT) AS z, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x, max(v) AS v FROM b, off
WHERE z + dz BETWEEN 0 AND 3 AND y + dy BETWEEN 0 AND 3 AND x + dx BETWEEN 0 AND 3 GROUP BY 1, 2, 3""",
        ),
    ),
    "a6_brick_summary": (
        lambda s, d: vo.brick_summary(voxels(s, d)),
        with_sql("voxel", "SELECT CAST(z // 8 AS INT) AS z, CAST(y // 8 AS INT) AS y, CAST(x // 8 AS INT) AS x, min(v) AS vmin, max(v) AS vmax, count(*) FILTER (v > 0) AS n_nonzero FROM voxel GROUP BY 1, 2, 3"),
    ),
    "s2_voxel_lookup": (lambda s, d: vo.at(voxels(s, d), 5, 7, 9), with_sql("voxel", "SELECT * FROM voxel WHERE z = 5 AND y = 7 AND x = 9")),
    "s6_box_scan": (
        lambda s, d: vo.box(voxels(s, d), (4, 8, 12), (20, 24, 28)),
        with_sql("voxel", "SELECT * FROM voxel WHERE z >= 4 AND z < 20 AND y >= 8 AND y < 24 AND x >= 12 AND x < 28"),
    ),
    "s9_block_read": (
        lambda s, d: vo.region(voxels(s, d), (-2, 28, 10), (8, 8, 8)),
        with_sql(
            "voxel",
            """, r AS (SELECT unnest(range(0, 8)) AS k) SELECT CAST(a.k - 2 AS INT) AS z, CAST(b.k + 28 AS INT) AS y, CAST(c.k + 10 AS INT) AS x, CAST(coalesce(v, 0) AS INT) AS v
 FROM r a, r b, r c LEFT JOIN voxel ON voxel.z = a.k - 2 AND voxel.y = b.k + 28 AND voxel.x = c.k + 10""",
        ),
    ),
    "f1_low_cut": (lambda s, d: vo.low_cut(voxels(s, d), 110), with_sql("voxel", "SELECT z, y, x, CASE WHEN v >= 110 THEN v ELSE 0 END AS v FROM voxel")),
    "f2_transfer_table": (
        lambda s, d: vo.transfer_table(s, POINTS).join(voxels(s, d).groupBy("v").agg(F.count("*").alias("n")), "v"),
        with_sql("voxel", f"SELECT v, r, g, b, a, n FROM ({_TF}) JOIN (SELECT v, count(*) AS n FROM voxel GROUP BY 1) USING (v)"),
    ),
    "f3_least_visible": (
        lambda s, d: voxels(s, d).withColumnRenamed("v", "seen").join(F.broadcast(vo.least_visible(vo.transfer_table(s, POINTS))), F.col("seen") >= F.col("v")).groupBy("v").agg(F.count("*").alias("n")),  # one row
        with_sql("voxel", f", l AS (SELECT CAST(coalesce(min(v) FILTER (a > 0), 255) AS INT) AS v FROM ({_TF})) SELECT l.v, count(*) AS n FROM voxel JOIN l ON voxel.v >= l.v GROUP BY 1"),
    ),
    "f8_boundary": (
        lambda s, d: st.boundary(voxels(s, d).where("v >= 120")),
        with_sql(
            "voxel",
            """, q AS (SELECT z, y, x FROM voxel WHERE v >= 120), o(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
SELECT DISTINCT q.z, q.y, q.x FROM q, o LEFT JOIN q n ON n.z = q.z + dz AND n.y = q.y + dy AND n.x = q.x + dx WHERE n.z IS NULL""",
        ),
    ),
    "f9_hysteresis": (
        lambda s, d: st.hysteresis(voxels(s, d).where("v >= 225"), voxels(s, d).where("v >= 190"), SHAPE),
        with_sql("voxel", "").replace("WITH ", "WITH RECURSIVE ", 1)
        + """, o(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)), weak AS (SELECT z, y, x FROM voxel WHERE v >= 190),
r AS (SELECT z, y, x FROM voxel WHERE v >= 225 UNION SELECT w.z, w.y, w.x FROM r, o JOIN weak w ON w.z = r.z + dz AND w.y = r.y + dy AND w.x = r.x + dx)
SELECT z, y, x FROM r""",
    ),
    "f10_gap_fill": (
        lambda s, d: st.gap_fill(voxels(s, d).where("v >= 150"), "x", SHAPE),
        with_sql(
            "voxel",
            """, q AS (SELECT z, y, x FROM voxel WHERE v >= 150), g AS (SELECT z, y, x, lead(x) OVER (PARTITION BY z, y ORDER BY x) AS e FROM q)
SELECT z, y, CAST(unnest(range(x + 1, e)) AS INT) AS x FROM g WHERE e - x > 1 AND e - x <= 3""",
        ),
    ),
    "f13_air_chunks": (
        lambda s, d: vo.seen_chunks(voxels(s, d).where("v >= 245"), 8, 1),
        with_sql("voxel", "SELECT DISTINCT CAST(z // 8 AS INT) AS z, CAST(y // 8 AS INT) AS y, CAST(x // 8 AS INT) AS x FROM voxel WHERE v >= 245"),
    ),
    "r1_composite": (
        lambda s, d: vo.composite(vo.low_cut(voxels(s, d), 60)).select("y", "x", "n", F.floor(F.col("alpha") * 1000 + 0.5).cast("long").alias("alpha"), F.floor(F.col("color") * 10 + 0.5).cast("long").alias("color")),
        with_sql(
            "voxel",
            """, l AS (SELECT y, x, z, CASE WHEN v >= 60 THEN v ELSE 0 END AS v FROM voxel),
t AS (SELECT *, coalesce(exp(sum(ln(1 - v / 255e0)) OVER (PARTITION BY y, x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS through FROM l)
SELECT y, x, CAST(count(*) FILTER (1 - through < 0.98) AS INT) AS n, CAST(floor(sum(through * v / 255e0) FILTER (1 - through < 0.98) * 1000 + 0.5) AS BIGINT) AS alpha,
 CAST(floor(sum(through * v / 255e0 * v) FILTER (1 - through < 0.98) * 10 + 0.5) AS BIGINT) AS color FROM t GROUP BY y, x""",
        ),
    ),
    "r1_transfer_composite": (
        lambda s, d: vo.shaded(voxels(s, d), vo.transfer_table(s, POINTS), 0.5, 1.5).select("y", "x", "n", *(F.floor(F.col(c) * 10000 + 0.5).cast("long").alias(c) for c in ("r", "g", "b", "alpha"))),
        with_sql(
            "voxel",
            f""", tf AS ({_TF}), l AS (SELECT y, x, z, 1 - pow(1 - a / 255e0, 0.75e0) AS al, r / 255e0 AS r, g / 255e0 AS g, b / 255e0 AS b FROM voxel JOIN tf USING (v)),
t AS (SELECT *, coalesce(exp(sum(ln(1 - al)) OVER (PARTITION BY y, x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS through FROM l)
SELECT y, x, CAST(count(*) FILTER (1 - through < 0.98) AS INT) AS n, """
            + ", ".join(f"CAST(floor(coalesce(sum(through * al{e}) FILTER (1 - through < 0.98), 0) * 10000 + 0.5) AS BIGINT) AS {c}" for c, e in (("r", " * r"), ("g", " * g"), ("b", " * b"), ("alpha", "")))
            + " FROM t GROUP BY y, x",
        ),
    ),
    "r2_projection": (
        lambda s, d: vo.projection(voxels(s, d)),
        with_sql("voxel", "SELECT y, x, max(v) AS mip, count(*) AS steps, min(z) FILTER (v > 12) AS depth FROM voxel GROUP BY y, x"),
    ),
    "r6_oblique_slab": (
        lambda s, d: vo.slab(voxels(s, d), (1, 2, 3), 60, 72),
        with_sql("voxel", "SELECT z, y, x, v, x + 2 * y + 3 * z AS d FROM voxel WHERE x + 2 * y + 3 * z >= 60 AND x + 2 * y + 3 * z < 72"),
    ),
    "g21_upsample": (
        lambda s, d: vo.pyramid_mean(voxels(s, d)).join(
            vo.dense_grid(s, SHAPE).select(*(vo.half(c).alias(c) for c in vo.ZYX), *(F.col(c).alias("f" + c) for c in vo.ZYX)), list(vo.ZYX), "right"
        ).select(*(F.col("f" + c).alias(c) for c in vo.ZYX), F.coalesce("v", F.lit(0)).cast("int").alias("v")),
        with_sql(
            "voxel grid",
            """, l1 AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, CAST((sum(v) + 4) // 8 AS INT) AS v FROM voxel GROUP BY 1, 2, 3)
SELECT g.z, g.y, g.x, CAST(coalesce(v, 0) AS INT) AS v FROM grid g LEFT JOIN l1 ON l1.z = g.z // 2 AND l1.y = g.y // 2 AND l1.x = g.x // 2""",
        ),
    ),
    "w1_median3": (lambda s, d: st.median(voxels(s, d), 1, SHAPE), _clamp(1, "SELECT z, y, x, list_sort(list(u))[14] AS v FROM nb GROUP BY z, y, x")),
    "w2_median5": (lambda s, d: st.median(voxels(s, d), 2, SHAPE), _clamp(2, "SELECT z, y, x, list_sort(list(u))[63] AS v FROM nb GROUP BY z, y, x")),
    "w2_median5_whole": (lambda s, d: st.median(voxels(s, d), 2, SHAPE), _clamp(2, "SELECT z, y, x, list_sort(list(u))[63] AS v FROM nb GROUP BY z, y, x")),
    "w3_unsharp": (
        lambda s, d: st.unsharp(voxels(s, d), 1, SHAPE),
        _clamp(1, "SELECT z, y, x, CAST(least(255, greatest(0, 54 * max(v) - sum(u)) // 27) AS INT) AS v FROM nb GROUP BY z, y, x"),
    ),
    "w4_max_pool": (lambda s, d: st.max_pool(voxels(s, d), 1, SHAPE), _clamp(1, "SELECT z, y, x, max(u) AS v FROM nb GROUP BY z, y, x")),
    "w5_gradient": (
        lambda s, d: st.gradient(voxels(s, d), SHAPE),
        with_sql(
            "voxel grid",
            "SELECT g.z, g.y, g.x"
            + "".join(f", CAST(coalesce(p{c}.v, 0) - coalesce(m{c}.v, 0) AS INT) AS g{c}" for c in "zyx")
            + " FROM grid g"
            + "".join(f" LEFT JOIN voxel {n}{c} ON " + " AND ".join(f"{n}{c}.{b} = g.{b}" + (sign if b == c else "") for b in "zyx") for c in "zyx" for n, sign in (("p", " + 1"), ("m", " - 1"))),
        ),
    ),
    "w5_tetrahedral_gradient": (
        lambda s, d: st.tetrahedral_gradient(voxels(s, d), SHAPE),
        with_sql(
            "voxel grid",
            ", o(dz, dy, dx) AS (VALUES " + ", ".join(map(str, st.TETRAHEDRON)) + ") SELECT g.z, g.y, g.x, " + ", ".join(f"CAST(sum(d{c} * coalesce(v, 0)) AS INT) AS g{c}" for c in "zyx")
            + " FROM grid g CROSS JOIN o LEFT JOIN voxel n ON n.z = g.z + dz AND n.y = g.y + dy AND n.x = g.x + dx GROUP BY 1, 2, 3",
        ),
    ),
    "w6_outward_normal": (
        lambda s, d: (lambda q: st.outward_normal(q, st.boundary(q), SHAPE))(voxels(s, d).where("v >= 200")).select(*vo.ZYX, "n_solid", *(F.floor(F.col("n" + c) * 1000 + 0.5).cast("long").alias("n" + c) for c in vo.ZYX)),
        with_sql(
            "voxel",
            f""", q AS (SELECT z, y, x FROM voxel WHERE v >= 200), o6(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
b AS (SELECT DISTINCT q.z, q.y, q.x FROM q, o6 LEFT JOIN q n ON n.z = q.z + dz AND n.y = q.y + dy AND n.x = q.x + dx WHERE n.z IS NULL), {_off(2)},
s AS (SELECT b.z, b.y, b.x, count(n.z) AS n_solid, """
            + ", ".join(f"sum(CASE WHEN n.z IS NULL THEN d{c} / sqrt(CAST(dz * dz + dy * dy + dx * dx AS DOUBLE)) ELSE 0 END) AS n{c}" for c in "zyx")
            + """ FROM b, off LEFT JOIN q n ON n.z = b.z + dz AND n.y = b.y + dy AND n.x = b.x + dx WHERE dz <> 0 OR dy <> 0 OR dx <> 0 GROUP BY b.z, b.y, b.x),
t AS (SELECT *, sqrt(nz * nz + ny * ny + nx * nx) AS l FROM s)
SELECT z, y, x, n_solid, """
            + ", ".join(f"CAST(floor(CASE WHEN l > 1e-9 THEN n{c} / l ELSE 0 END * 1000 + 0.5) AS BIGINT) AS n{c}" for c in "zyx")
            + " FROM t",
        ),
    ),
    "w7_distance_transform": (
        lambda s, d: st.distance_transform(voxels(s, d).where("v >= 240"), SHAPE, border=16),
        DISTANCE + "SELECT z, y, x, d2 FROM dt",
    ),
    "w7_nearly_empty": (
        lambda s, d: st.distance_transform(voxels(s, d).where("z = 2 and y = 3 and v >= 245"), SHAPE, border=16),
        DISTANCE.replace("WHERE v >= 240", "WHERE z = 2 AND y = 3 AND v >= 245") + "SELECT z, y, x, d2 FROM dt",
    ),
    "a1_grown_pyramid": (
        lambda s, d: vo.pyramid(grown_voxels(s, d), 3),
        with_sql(
            "side grown",
            ", " + ", ".join(f"l{k} AS (SELECT CAST(z // 2 AS INT) AS z, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST((sum(v) + 4) // 8 AS INT) AS v FROM {'grown' if k == 1 else f'l{k - 1}'} GROUP BY 1, 2, 3)" for k in (1, 2, 3))
            + " " + " UNION ALL ".join(f"SELECT {k} AS level, * FROM l{k}" for k in (1, 2, 3)),
        ),
    ),
    "w1_grown_median": (
        lambda s, d: st.median(grown_voxels(s, d), 1, (grown_side(s, d),) * 3),
        with_sql(
            "side grown",
            f""", r AS (SELECT unnest(range(0, (SELECT n FROM side))) AS k), g AS (SELECT CAST(a.k AS INT) AS z, CAST(b.k AS INT) AS y, CAST(c.k AS INT) AS x FROM r a, r b, r c),
d AS (SELECT z, y, x, CAST(coalesce(v, 0) AS INT) AS v FROM g LEFT JOIN grown USING (z, y, x)), {OFF27},
p AS (SELECT z, y, x, greatest(0, least(n - 1, z + dz)) AS nz, greatest(0, least(n - 1, y + dy)) AS ny, greatest(0, least(n - 1, x + dx)) AS nx FROM d, off, side)
SELECT p.z, p.y, p.x, list_sort(list(d.v))[14] AS v FROM p JOIN d ON d.z = nz AND d.y = ny AND d.x = nx GROUP BY 1, 2, 3""",
        ),
    ),
    "f9_grown_hysteresis": (
        _grown_hysteresis,
        with_sql("side grown", "").replace("WITH ", "WITH RECURSIVE ", 1)
        + """, o(dz, dy, dx) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)), weak AS (SELECT z, y, x FROM grown WHERE v >= 170),
r AS (SELECT z, y, x FROM grown WHERE v >= 225 UNION SELECT w.z, w.y, w.x FROM r, o JOIN weak w ON w.z = r.z + dz AND w.y = r.y + dy AND w.x = r.x + dx)
SELECT z, y, x FROM r""",
    ),
}
