"""Queries of residual terms, and small jobs around traces and predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import hooks
from lamina.functions.derive import SQL, predictions, surface_points, voxels, with_sql
from lamina.operators import residuals as re
from lamina.operators import stats as st
from lamina.operators import stencil as se
from lamina.operators import surface as su
from lamina.plans.points import _T, _scaled, _sqls
from lamina.plans.stores import FIT, _text
from lamina.plans.volumes import DISTANCE
from lamina.session import cut, room
from lamina.sources import sidecars, volumes

BEND = 0.9
#: Jobs that share the segments of a trace: their number doesn't grow with the segments.
JOBS = 8
_AX = "xyz"


def _small(s, d, by):
    sp = surface_points(s, d)
    return sp.select("seg_id", "j", "i", *((F.col(c) / by).alias(c) for c in _AX))


def _cells(s, d):
    return surface_points(s, d).select("seg_id", "j", "i", *_AX, (F.col("i") / 50.0).alias("wind"))


def _hinge_sql():
    part = []
    for k, name, (dj, di) in ((0, "i", (0, 1)), (1, "j", (1, 0))):
        d1, d2 = [f"(p.{c} - a{k}.{c})" for c in _AX], [f"(c{k}.{c} - p.{c})" for c in _AX]
        dot = lambda u, v: "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v, strict=True)) + ")"
        cosine = f"({dot(d1, d2)} / sqrt({dot(d1, d1)} * {dot(d2, d2)}))"
        third = [f"(a{k}.{c} - 3 * p.{c} + 3 * c{k}.{c} - d{k}.{c})" for c in _AX]
        known = f"{dot(d1, d1)} * {dot(d2, d2)} > 1e-24"
        pen = f"greatest(0, {BEND!r}e0 - {cosine})"
        part += [_sqls(f"CASE WHEN {known} THEN {pen} + 4 * {pen} * {pen} END", f"bend_{name}", 5), _sqls(f"CASE WHEN {known} THEN greatest(0, 0 - {cosine}) END", f"fold_{name}", 5), _sqls(dot(third, third), f"curv_{name}", 3)]
    joins = "".join(f" LEFT JOIN sp {n}{k} ON {n}{k}.seg_id = p.seg_id AND {n}{k}.j = p.j + {m if k else 0} AND {n}{k}.i = p.i + {0 if k else m}" for k in (0, 1) for n, m in (("a", -1), ("c", 1), ("d", 2)))
    return with_sql("sp", "SELECT p.seg_id, p.j, p.i, " + ", ".join(part) + " FROM sp p" + joins)


def _variants(s, d):
    """Four maps in a row as variants of one: as it is, mirrored in x, in y, and in both."""
    return predictions(s, d).select(F.expr("vec_id div 4").alias("map"), (F.col("vec_id") % 4).cast("int").alias("variant"), "py", "px", "p")


def _trace_jobs(s, d):
    """The bounds of every segment, found by jobs side by side, each for its share of the seeds' segments."""
    sp = surface_points(s, d)
    share = F.pmod(F.hash("seg_id"), F.lit(JOBS))
    found = hooks.side_by_side(s, [lambda k=k: cut(su.bounds(sp.where(share == k))) for k in range(JOBS)], JOBS)
    return reduce(DataFrame.union, found)


def _predict_tree(s, d):
    """Metadata of a tree for predictions beside a volume: the volume's shape, other chunks, a name."""
    meta = voxels(s, d).agg(*(F.max(c).alias(c) for c in "zyx")).select(F.to_json(F.struct(F.lit(2).alias("zarr_format"), F.array(*((F.col(c) + 1).cast("int") for c in "zyx")).alias("shape"), F.array(*(F.lit(8),) * 3).alias("chunks"), F.lit("|u1").alias("dtype"), F.lit(0).alias("fill_value"), F.lit("C").alias("order"))).alias("value"))
    return sidecars.zarr_levels(_text(s, meta, "predict")).select(F.get("shape", F.lit(0)).alias("nz"), F.get("shape", F.lit(2)).alias("nx"), F.get("chunks", F.lit(1)).alias("chunk"))


def _stack_wrap(s, d):
    """Rescaled prediction maps as a stack of bytes, written as raw chunks of a mirror and read back."""
    v = predictions(s, d).select(F.col("vec_id").cast("int").alias("z"), F.col("py").alias("y"), F.col("px").alias("x"), F.floor(st.rescaled(F.col("p")) * 255).cast("int").alias("v"))
    path = room(s, "stack")
    volumes.write_mirror(v, path, 8, s.createDataFrame([(0, 0, 0)], "cz int, cy int, cx int"))
    return volumes.raw_voxels(volumes.mirror_status(s, path, (-(-(v.agg(F.max("z")).first()[0] + 1) // 8), 1, 1)), 8)


def _around_sql():
    """Cells that come back within 14, with both normals."""
    nrm = (
        "n0 AS (SELECT p.seg_id, p.j, p.i, " + ", ".join(f"coalesce(r.{c}, p.{c}) - coalesce(l.{c}, p.{c}) AS u{c}, coalesce(d.{c}, p.{c}) - coalesce(t.{c}, p.{c}) AS v{c}" for c in _AX)
        + " FROM q p LEFT JOIN q r ON r.seg_id = p.seg_id AND r.j = p.j AND r.i = p.i + 1 LEFT JOIN q l ON l.seg_id = p.seg_id AND l.j = p.j AND l.i = p.i - 1"
        + " LEFT JOIN q d ON d.seg_id = p.seg_id AND d.j = p.j + 1 AND d.i = p.i LEFT JOIN q t ON t.seg_id = p.seg_id AND t.j = p.j - 1 AND t.i = p.i"
        + " WHERE (r.i IS NOT NULL OR l.i IS NOT NULL) AND (d.i IS NOT NULL OR t.i IS NOT NULL)),"
        + " n1 AS (SELECT *, uy * vz - uz * vy AS mx, uz * vx - ux * vz AS my, ux * vy - uy * vx AS mz FROM n0), nr AS (SELECT seg_id, j, i, mx / s AS x, my / s AS y, mz / s AS z FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS s FROM n1) WHERE s > 1e-12)"
    )
    return with_sql(
        "sp",
        f", q AS (SELECT seg_id, j, i, x / 16 AS x, y / 16 AS y, z / 16 AS z FROM sp), {nrm}, c AS (SELECT a.seg_id, a.j, a.i, " + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in _AX) + " AS d2, b.j AS j2, b.i AS i2 FROM q a JOIN q b ON a.seg_id = b.seg_id WHERE abs(a.i - b.i) > 8 OR abs(a.j - b.j) > 8),"
        " k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, j, i ORDER BY d2, j2, i2) AS n FROM c WHERE d2 <= 196) WHERE n = 1),"
        " e AS (SELECT k.*, a.x * b.x + a.y * b.y + a.z * b.z AS along, greatest(abs(k.i - i2), abs(k.j - j2)) AS steps FROM k LEFT JOIN nr a ON a.seg_id = k.seg_id AND a.j = k.j AND a.i = k.i LEFT JOIN nr b ON b.seg_id = k.seg_id AND b.j = j2 AND b.i = i2)"
        f" SELECT seg_id, j, i, {_sqls('(14 - sqrt(d2)) / 14', 'self_term', 5)} FROM e WHERE (along IS NULL OR along < -0.3 OR (along > 0.3 AND steps > 20)) AND sqrt(d2) > 1e-6 AND sqrt(d2) < 14",
    )


QUERIES = {
    "i4_hinge_terms": (lambda s, d: re.hinges(surface_points(s, d), BEND).select("seg_id", "j", "i", *(_scaled(f"{n}_{a}", 3 if n == "curv" else 5) for a in "ij" for n in ("bend", "fold", "curv"))), _hinge_sql()),
    "i4_space_line": (
        lambda s, d: re.space_line(_small(s, d, 32), se.distance_transform(voxels(s, d).where("v >= 240"), (32, 32, 32)).select("z", "y", "x", F.col("d2").alias("v")), 8).select("seg_id", "j", "i", _scaled("space", 4)),
        DISTANCE.replace("WITH ", f"WITH sp AS ({SQL['sp']}),\n", 1)
        + ", q AS (SELECT {'s': p.seg_id, 'j': p.j, 'i': p.i, 'k': k} AS pt_id, " + ", ".join(f"p.{c} / 32 * (1 - k / 8e0) + r.{c} / 32 * (k / 8e0) AS {c}" for c in _AX) + " FROM sp p JOIN sp r ON r.seg_id = p.seg_id AND r.j = p.j AND r.i = p.i + 1, (SELECT unnest(range(1, 8)) AS k) o), "
        + _T.format("q")
        + f", sv AS (SELECT t.pt_id, sum(wx * wy * wz * d2) AS value FROM tap t JOIN dt ON dt.z = iz AND dt.y = iy AND dt.x = ix GROUP BY 1) SELECT pt_id.s AS seg_id, pt_id.j AS j, pt_id.i AS i, {_sqls('avg(coalesce(value, 0))', 'space', 4)} FROM q LEFT JOIN sv USING (pt_id) GROUP BY 1, 2, 3",
    ),
    "i4_winding_term": (
        lambda s, d: re.winding(_cells(s, d), FIT, (490.0, 100.0), 1000.0).select("seg_id", "j", "i", _scaled("wind_term")),
        with_sql(
            "sp",
            ", g AS (SELECT *, x - 490 AS ux, y - 100 AS uy, i / 50e0 AS wind FROM sp), t AS (SELECT *, atan2(uy, ux) AS th, sqrt(ux * ux + uy * uy) AS rho FROM g), r AS (SELECT *, (rho - ("
            + " + ".join(f"{r!r}e0 * greatest(0, 1 - abs(z / 500 - {k}))" for k, r in enumerate(FIT["r0"]))
            + " + 0.5e0 * cos(th) - 0.25e0 * sin(th) + 0.125e0 * cos(2 * th) + 0.0625e0 * sin(2 * th) + 3 * wind)) / 3 AS r FROM t) SELECT seg_id, j, i, "
            + f"{_sqls('r / sqrt(1 + r * r)', 'wind_term')} FROM r WHERE rho >= 1e-6",
        ),
    ),
    "i4_self_term": (lambda s, d: re.self_approach(_small(s, d, 16), 14.0).select("seg_id", "j", "i", _scaled("self_term", 5)), _around_sql()),
    "a24_test_time_variants": (
        lambda s, d: st.merged_variants(_variants(s, d), 8).select("map", "py", "px", _scaled("p")),
        with_sql("pred", f"SELECT vec_id // 4 AS map, CAST(CASE WHEN vec_id % 4 >= 2 THEN 7 - py ELSE py END AS INT) AS py, CAST(CASE WHEN vec_id % 2 = 1 THEN 7 - px ELSE px END AS INT) AS px, {_sqls('avg(p)', 'p')} FROM pred GROUP BY 1, 2, 3"),
    ),
    "e7_trace_jobs": (_trace_jobs, with_sql("sp", "SELECT seg_id, " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _AX) + ", count(*) AS nvalid FROM sp GROUP BY 1")),
    "m6_predict_tree": (_predict_tree, with_sql("voxel", "SELECT CAST(max(z) + 1 AS INT) AS nz, CAST(max(x) + 1 AS INT) AS nx, 8 AS chunk FROM voxel")),
    "m7_stack_wrap": (
        _stack_wrap,
        with_sql("pred", ", t AS (SELECT CAST(vec_id AS INT) AS z, py AS y, px AS x, CAST(floor(least(greatest((p - 0.25) * 2, 0), 1) * 255) AS INT) AS v FROM pred) SELECT * FROM t WHERE v > 0"),
    ),
}
