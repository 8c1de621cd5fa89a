"""Spatial queries on the tile index and on surface points.

Distance joins are equi-joins on hash cells: one side is sent to the cells within reach, the other
to its own cell, and the exact distance decides. Nothing is compared with everything. Both sides are
shuffled: a side that is sent to the cells around it is larger than Spark estimates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.surface import CELL, XYZ
from lamina.session import by_shuffle


def _dot_range(prefix: str, normal: Sequence[float]) -> tuple[Column, Column]:
    lo = sum((n * F.col(f"{prefix}{c}_{'lo' if n >= 0 else 'hi'}") for c, n in zip(XYZ, normal, strict=True)), F.lit(0.0))
    hi = sum((n * F.col(f"{prefix}{c}_{'hi' if n >= 0 else 'lo'}") for c, n in zip(XYZ, normal, strict=True)), F.lit(0.0))
    return lo, hi


def plane_query(boxes: DataFrame, normal: Sequence[float], offset: float, margin: float, lo: Sequence[float] | None = None, hi: Sequence[float] | None = None) -> DataFrame:
    """Segments with a tile that the plane comes within ``margin`` of (and that meets the box lo..hi), in order of segment."""
    hit = F.lit(True)
    for prefix in ("s", ""):
        a, b = _dot_range(prefix, normal)
        hit = hit & (a - margin <= offset) & (b + margin >= offset)
        for k, c in enumerate(XYZ if lo is not None else ()):
            hit = hit & (F.col(f"{prefix}{c}_hi") >= lo[k]) & (F.col(f"{prefix}{c}_lo") <= hi[k])
    return boxes.where(hit).groupBy("seg_id").agg(F.count("*").alias("n_tiles"))


def near_query(boxes: DataFrame, point: Sequence[float], radius: float, k: int) -> DataFrame:
    """The ``k`` nearest segments with a tile within ``radius`` of a point, nearest first, ties by segment; ``hits`` is their number before the cut."""
    gap = [F.greatest(F.col(f"{c}_lo") - p, p - F.col(f"{c}_hi"), F.lit(0.0)) for c, p in zip(XYZ, point, strict=True)]
    best = boxes.groupBy("seg_id").agg(F.min(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("d2")).where(F.col("d2") <= radius * radius)
    top = best.orderBy("d2", "seg_id").limit(k)
    return top.crossJoin(F.broadcast(best.agg(F.count("*").alias("hits"))))  # one row


def overlap(boxes: DataFrame, tol: float, grid: int = 64, coarse: float = 256.0) -> DataFrame:
    """For ordered pairs of segments whose boxes come within ``tol``: the share of a's tiles whose centre is in a cell of the shared box's
    ``grid``**3 that a tile of b, grown by ``tol``, reaches."""
    seg = boxes.select("seg_id", *(f"s{c}_{n}" for c in XYZ for n in ("lo", "hi"))).distinct()
    cells = seg
    for c in XYZ:
        cells = cells.withColumn("c" + c, F.explode(F.sequence(F.floor((F.col(f"s{c}_lo") - tol) / coarse), F.floor((F.col(f"s{c}_hi") + tol) / coarse))))
    a = cells.select(F.col("seg_id").alias("a"), *("c" + c for c in XYZ), *(F.col(f"s{c}_{n}").alias(f"a{c}_{n}") for c in XYZ for n in ("lo", "hi")))
    b = cells.select(F.col("seg_id").alias("b"), *("c" + c for c in XYZ), *(F.col(f"s{c}_{n}").alias(f"b{c}_{n}") for c in XYZ for n in ("lo", "hi")))
    pair = a.join(by_shuffle(b), ["c" + c for c in XYZ]).where("a != b")
    pair = pair.select("a", "b", *((F.greatest(f"a{c}_lo", f"b{c}_lo") - tol).alias(f"{c}0") for c in XYZ), *((F.least(f"a{c}_hi", f"b{c}_hi") + tol).alias(f"{c}1") for c in XYZ)).distinct()
    pair = pair.where(" and ".join(f"{c}0 < {c}1" for c in XYZ)).select("a", "b", *(f"{c}0" for c in XYZ), *(((F.col(f"{c}1") - F.col(f"{c}0")) / grid).alias(f"{c}s") for c in XYZ))
    tb = by_shuffle(pair).join(boxes, pair["b"] == boxes["seg_id"])
    for c in XYZ:
        low = F.greatest(F.lit(0), F.floor((F.col(f"{c}_lo") - tol - F.col(f"{c}0")) / F.col(f"{c}s"))).cast("int")
        high = F.least(F.lit(grid - 1), F.floor((F.col(f"{c}_hi") + tol - F.col(f"{c}0")) / F.col(f"{c}s"))).cast("int")
        tb = tb.withColumns({f"{c}a": low, f"{c}b": high}).where(f"{c}a <= {c}b")
        tb = tb.withColumn("h" + c, F.explode(F.sequence(F.expr(f"{c}a div 8"), F.expr(f"{c}b div 8"))))  # blocks of cells; the cell itself is tested after the join
    tb = tb.select("a", "b", *("h" + c for c in XYZ), *(f"{c}{k}" for c in XYZ for k in "ab"))
    centre = {c: (0.5 * (F.col(f"{c}_lo") + F.col(f"{c}_hi")) - F.col(f"{c}0")) / F.col(f"{c}s") for c in XYZ}
    ta = by_shuffle(pair).join(boxes, pair["a"] == boxes["seg_id"]).select("a", "b", "tj", "ti", *(F.floor(centre[c]).cast("int").alias("k" + c) for c in XYZ))
    ta = ta.select("*", *(F.expr(f"k{c} div 8").cast("long").alias("h" + c) for c in XYZ))
    inside = " and ".join(f"k{c} >= {c}a and k{c} <= {c}b" for c in XYZ)
    hit = ta.join(by_shuffle(tb), ["a", "b", *("h" + c for c in XYZ)]).where(inside).select("a", "b", "tj", "ti").distinct().groupBy("a", "b").agg(F.count("*").alias("hits"))
    every = ta.groupBy("a", "b").agg(F.count("*").alias("n"))
    return every.join(by_shuffle(hit), ["a", "b"], "left").select("a", "b", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("overlap"))


def _cells(df: DataFrame, size: float, reach: int) -> DataFrame:
    """Cell coordinates ``cx``, ``cy``, ``cz``; with a reach the row is sent to every cell so far around its own."""
    for c in XYZ:
        own = F.floor(F.col(c) / size).cast("int")
        df = df.withColumn("c" + c, F.explode(F.sequence(own - reach, own + reach)) if reach else own)
    return df


def nearest(points: DataFrame, sp: DataFrame, tol: float, step: int = 2) -> DataFrame:
    """The nearest surface point within ``tol`` of each of ``points(pt_id, x, y, z)``, among every ``step``-th row and column; ties by segment, row, column."""
    s = _cells(sp.where((F.col("i") % step == 0) & (F.col("j") % step == 0)), tol, 0).select(*CELL, *(F.col(c).alias("s" + c) for c in XYZ), *("c" + c for c in XYZ))
    pair = _cells(points.select("pt_id", *XYZ), tol, 1).join(by_shuffle(s), ["c" + c for c in XYZ])
    d2 = sum(((F.col(c) - F.col("s" + c)) ** 2 for c in XYZ), F.lit(0.0))
    best = pair.select("pt_id", F.struct(d2.alias("d2"), *CELL).alias("s")).where(F.col("s.d2") <= tol * tol).groupBy("pt_id").agg(F.min("s").alias("s"))
    return best.select("pt_id", *(F.col("s." + c).alias(c) for c in ("d2", *CELL)))


def self_overlap(sp: DataFrame, gap: float, apart: int = 8) -> DataFrame:
    """Of each point the nearest one of its segment that is more than ``apart`` grid cells away on an axis, but within ``gap``; ties by row, column."""
    near = _cells(sp, gap, 0).select("seg_id", *("c" + c for c in XYZ), F.col("j").alias("j2"), F.col("i").alias("i2"), *(F.col(c).alias("s" + c) for c in XYZ))
    pair = _cells(sp, gap, 1).join(by_shuffle(near), ["seg_id", *("c" + c for c in XYZ)])
    d2 = sum(((F.col(c) - F.col("s" + c)) ** 2 for c in XYZ), F.lit(0.0))
    far = (F.abs(F.col("i") - F.col("i2")) > apart) | (F.abs(F.col("j") - F.col("j2")) > apart)
    best = pair.where(far & (d2 <= gap * gap)).groupBy(*CELL).agg(F.min(F.struct(d2.alias("d2"), "j2", "i2")).alias("s"))
    return best.select(*CELL, *(F.col("s." + c).alias(c) for c in ("d2", "j2", "i2")))


def support(points: DataFrame, sp: DataFrame, radius: float) -> DataFrame:
    """Number of segments with a point within ``radius`` of each point; points without any are absent."""
    s = _cells(sp, radius, 0).select("seg_id", *("c" + c for c in XYZ), *(F.col(c).alias("s" + c) for c in XYZ))
    pair = _cells(points.select("pt_id", *XYZ), radius, 1).join(by_shuffle(s), ["c" + c for c in XYZ])
    d2 = sum(((F.col(c) - F.col("s" + c)) ** 2 for c in XYZ), F.lit(0.0))
    return pair.where(d2 <= radius * radius).select("pt_id", "seg_id").distinct().groupBy("pt_id").agg(F.count("*").alias("n"))


def line_distance(points: DataFrame, lines: DataFrame, tol: float) -> DataFrame:
    """Squared distance of ``points(pt_id, x, y)`` to the nearest of ``lines(x0, y0, x1, y1)``, where it is within ``tol``; lines are sent to all cells of their box."""
    span = lambda a, b, pad: F.sequence(F.floor((F.least(a, b) - pad) / tol).cast("int"), F.floor((F.greatest(a, b) + pad) / tol).cast("int"))
    l = lines.withColumn("cx", F.explode(span("x0", "x1", tol))).withColumn("cy", F.explode(span("y0", "y1", tol)))
    p = points.select("pt_id", "x", "y", F.floor(F.col("x") / tol).cast("int").alias("cx"), F.floor(F.col("y") / tol).cast("int").alias("cy"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / l2))).otherwise(0.0)
    ex, ey = F.col("x") - (F.col("x0") + t * dx), F.col("y") - (F.col("y0") + t * dy)
    return p.join(by_shuffle(l), ["cx", "cy"]).select("pt_id", (ex * ex + ey * ey).alias("d2")).where(F.col("d2") <= tol * tol).groupBy("pt_id").agg(F.min("d2").alias("d2"))


def ray_priority(requests: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` requests: lower priority number first, then nearer, then by key."""
    return requests.orderBy("priority", "d2", *[c for c in requests.columns if c not in ("priority", "d2")]).limit(budget)


def missing(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct wanted keys that aren't present."""
    return wanted.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")
