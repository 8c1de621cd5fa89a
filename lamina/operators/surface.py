"""Operators on surfaces: ``sp(seg_id, j, i, x, y, z)`` rows of valid grid points.

Quads and neighbourhoods are assembled by sending each point to the cells it belongs to and
aggregating by cell: one shuffle by (seg_id, j, i), no self-join, and absent corners show as nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.stats import ranked

CELL = ("seg_id", "j", "i")
XYZ = ("x", "y", "z")


def around(sp: DataFrame, offsets: dict[str, tuple[int, int]], extra: Sequence[str] = (), base: Sequence[str] = XYZ) -> DataFrame:
    """Of every cell that some point is next to: the struct of the point at (j + dj, i + di) under each name, null where there is none."""
    names = [*base, *extra]
    o = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(dj).alias("dj"), F.lit(di).alias("di")) for n, (dj, di) in offsets.items()))
    sent = sp.select(*CELL, F.struct(*names).alias("p"), F.explode(o).alias("o"))
    sent = sent.select("seg_id", (F.col("j") - F.col("o.dj")).alias("j"), (F.col("i") - F.col("o.di")).alias("i"), F.col("o.n").alias("n"), "p")
    return sent.groupBy(*CELL).agg(*(F.max(F.when(F.col("n") == n, F.col("p"))).alias(n) for n in offsets))


CORNERS = {"p00": (0, 0), "p10": (0, 1), "p01": (1, 0), "p11": (1, 1)}


def quads(sp: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Cells whose four corners are valid: p00, p10 (i + 1), p01 (j + 1), p11."""
    return around(sp, CORNERS, extra).dropna(subset=list(CORNERS))


def sub(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in XYZ]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def bounds(sp: DataFrame) -> DataFrame:
    """Bounding box and number of valid points of each segment."""
    return sp.groupBy("seg_id").agg(*(f(c).alias(f"{c}_{n}") for c in XYZ for f, n in ((F.min, "lo"), (F.max, "hi"))), F.count("*").alias("nvalid"))


def row_bounds(sp: DataFrame) -> DataFrame:
    """Zone map of each grid row."""
    return sp.groupBy("seg_id", "j").agg(*(f(c).alias(f"{c}_{n}") for c in XYZ for f, n in ((F.min, "lo"), (F.max, "hi"))))


def tiles(sp: DataFrame, size: int) -> DataFrame:
    """Tile index: bounds of each tile of ``size`` cells, quantised to 16 bits over the segment's box (lo down, hi up).

    A point on a tile's first row or column also bounds the tile before it. The segment boxes have
    one row for each segment and join by seg_id.
    """
    box = bounds(sp)
    span = lambda c: F.sequence(F.expr(f"greatest({c} - 1, 0) div {size}").cast("int"), F.expr(f"{c} div {size}").cast("int"))
    sent = sp.select("seg_id", *XYZ, F.explode(span("j")).alias("tj"), "i").select("seg_id", *XYZ, "tj", F.explode(span("i")).alias("ti"))
    part = sent.groupBy("seg_id", "tj", "ti").agg(*(f(c).alias(f"{n}{c}") for c in XYZ for f, n in ((F.min, "a"), (F.max, "b"))))
    q = lambda c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / 65535.0).otherwise(1.0)
    out = part.join(box, "seg_id")
    return out.select(
        "seg_id", "tj", "ti",
        *(F.least(F.lit(65535), F.floor((F.col("a" + c) - F.col(c + "_lo")) / q(c))).cast("int").alias("lo_" + c) for c in XYZ),
        *(F.least(F.lit(65535), F.ceil((F.col("b" + c) - F.col(c + "_lo")) / q(c))).cast("int").alias("hi_" + c) for c in XYZ),
    )


def tile_boxes(index: DataFrame, box: DataFrame) -> DataFrame:
    """World bounds of tiles, and of their segments: ``x_lo``.. of the tile, ``sx_lo``.. of the segment."""
    b = box.select("seg_id", *(F.col(f"{c}_{n}").alias(f"s{c}_{n}") for c in XYZ for n in ("lo", "hi")))
    q = lambda c: F.when(F.col(f"s{c}_hi") > F.col(f"s{c}_lo"), (F.col(f"s{c}_hi") - F.col(f"s{c}_lo")) / 65535.0).otherwise(1.0)
    world = [(F.col(f"s{c}_lo") + q(c) * F.col(f"{n}_{c}")).alias(f"{c}_{n}") for c in XYZ for n in ("lo", "hi")]
    return index.join(b, "seg_id").select("seg_id", "tj", "ti", *world, *(f"s{c}_{n}" for c in XYZ for n in ("lo", "hi")))


def decimate(sp: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th row and column."""
    return sp.where((F.col("i") % stride == 0) & (F.col("j") % stride == 0)).select("seg_id", *(F.expr(f"{c} div {stride}").cast("int").alias(c) for c in "ji"), *XYZ)


def normals(sp: DataFrame) -> DataFrame:
    """Unit normals from central differences that shrink to one side at gaps; none where an axis has no neighbour."""
    n = around(sp, {"p": (0, 0), "r": (0, 1), "l": (0, -1), "d": (1, 0), "u": (-1, 0)}).where("p is not null")
    pick = lambda a: F.coalesce(F.col(a), F.col("p"))
    n = n.where("(r is not null or l is not null) and (d is not null or u is not null)")
    du = [pick("r")[c] - pick("l")[c] for c in XYZ]
    dv = [pick("d")[c] - pick("u")[c] for c in XYZ]
    m = cross(du, dv)
    size = length(m)
    return n.where(size > 1e-12).select(*CELL, *((a / size).alias("n" + c) for a, c in zip(m, XYZ, strict=True)))


def area(sp: DataFrame) -> DataFrame:
    """Area of each segment as two triangles a quad, and the number of quads."""
    one = length(cross(sub("p10", "p00"), sub("p01", "p00")))
    two = length(cross(sub("p11", "p10"), sub("p01", "p10")))
    return quads(sp).select("seg_id", (0.5 * (one + two)).alias("a")).groupBy("seg_id").agg(F.sum("a").alias("area"), F.count("*").alias("n_quads"))


def bends(sp: DataFrame, step: int = 1) -> DataFrame:
    """Cosine of the turn at each point along each grid axis (``axis`` 0 along i, 1 along j), between the steps to it and from it."""
    o = {"p": (0, 0), "a0": (0, -step), "b0": (0, step), "a1": (-step, 0), "b1": (step, 0)}
    n = around(sp, o).where("p is not null")
    turn = [F.when(F.col(f"a{k}").isNotNull() & F.col(f"b{k}").isNotNull(), F.struct(F.lit(k).alias("axis"), dot(sub("p", f"a{k}"), sub(f"b{k}", "p")).alias("dot"), (dot(sub("p", f"a{k}"), sub("p", f"a{k}")) * dot(sub(f"b{k}", "p"), sub(f"b{k}", "p"))).alias("l2"))) for k in (0, 1)]
    n = n.select(*CELL, F.explode(F.array(*turn)).alias("t")).where("t is not null and t.l2 > 1e-24")
    return n.select(*CELL, F.col("t.axis").alias("axis"), (F.col("t.dot") / F.sqrt(F.col("t.l2"))).alias("cos"))


def rows_across(sp: DataFrame, axis: str, level: float) -> DataFrame:
    """Edges of rows whose ends (``a``, ``b``) lie on different sides of a level of an axis; rows whose range doesn't hold the level are passed over by their bounds."""
    rows = row_bounds(sp).where((F.col(f"{axis}_lo") <= level) & (F.col(f"{axis}_hi") >= level)).select("seg_id", "j")
    near = sp.join(rows, ["seg_id", "j"], "left_semi")
    nxt = near.select("seg_id", "j", (F.col("i") - 1).alias("i"), F.col(axis).alias("b"))
    return near.select(*CELL, F.col(axis).alias("a")).join(nxt, list(CELL)).where((F.col("a") <= level) != (F.col("b") <= level))


def mesh_quality(sp: DataFrame, kink: float = 0.8) -> DataFrame:
    """Of each segment: folds (turns over 90 degrees), kinks (cosine under ``kink``), mean squared twist, and the share of its grid box that is filled."""
    b = bends(sp).groupBy("seg_id").agg(F.count_if(F.col("cos") < 0).alias("folds"), F.count_if((F.col("cos") >= 0) & (F.col("cos") < kink)).alias("kinks"))
    n = cross(sub("p10", "p00"), sub("p01", "p00"))
    t = dot(n, sub("p11", "p00")) / length(n)
    tw = quads(sp).where(length(n) > 1e-12).select("seg_id", (t * t).alias("t2")).groupBy("seg_id").agg(F.avg("t2").alias("twist2"))
    fill = sp.groupBy("seg_id").agg((F.count("*") / ((F.max("i") - F.min("i") + 1) * (F.max("j") - F.min("j") + 1))).alias("fill"))
    return fill.join(b, "seg_id", "left").join(tw, "seg_id", "left").select("seg_id", "fill", F.coalesce("folds", F.lit(0)).alias("folds"), F.coalesce("kinks", F.lit(0)).alias("kinks"), "twist2")


def slant(sp: DataFrame) -> DataFrame:
    """Shear of each quad's frame: |e1 . e2| / |e1|**2."""
    e1, e2 = sub("p10", "p00"), sub("p01", "p00")
    return quads(sp).where(dot(e1, e1) > 1e-12).select(*CELL, (F.abs(dot(e1, e2)) / dot(e1, e1)).alias("slant"))


def stretch(sp: DataFrame, ideal: float) -> DataFrame:
    """log2 of the mean distance to the next points over the ideal step, clamped to -1..1."""
    n = around(sp, {"p": (0, 0), "r": (0, 1), "d": (1, 0)}).where("p is not null and r is not null and d is not null")
    mean = (length(sub("r", "p")) + length(sub("d", "p"))) / 2
    return n.select(*CELL, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log2(mean / ideal))).alias("stretch"))


def untorn(sp: DataFrame, step: float, factor: float = 1.75) -> DataFrame:
    """Points without an edge to a 4-neighbour longer than ``factor`` steps."""
    n = around(sp, {"p": (0, 0), "r": (0, 1), "l": (0, -1), "d": (1, 0), "u": (-1, 0)}).where("p is not null")
    far = F.greatest(*(F.coalesce(dot(sub(a, "p"), sub(a, "p")), F.lit(0.0)) for a in "rldu"))
    return n.where(far <= (factor * step) ** 2).select(*CELL, *(F.col("p." + c).alias(c) for c in XYZ))


def subdivide(sp: DataFrame) -> DataFrame:
    """Grid of 2w - 1 by 2h - 1: points, and midpoints of neighbours along i, along j and of whole quads."""
    two = lambda c: (F.col(c) * 2).cast("int")
    same = sp.select("seg_id", two("j").alias("j"), two("i").alias("i"), *XYZ)
    n = around(sp, CORNERS)
    along = lambda o, k: n.where(F.col("p00").isNotNull() & F.col(o).isNotNull()).select("seg_id", (two("j") + k[0]).alias("j"), (two("i") + k[1]).alias("i"), *(((F.col("p00." + c) + F.col(f"{o}.{c}")) / 2).alias(c) for c in XYZ))
    mid = n.dropna(subset=list(CORNERS)).select("seg_id", (two("j") + 1).alias("j"), (two("i") + 1).alias("i"), *((sum((F.col(f"{p}.{c}") for p in CORNERS), F.lit(0.0)) / 4).alias(c) for c in XYZ))
    return same.union(along("p10", (0, 1))).union(along("p01", (1, 0))).union(mid)


#: Marching squares, fixed values: for corner signs 0 to 15, pairs of edges (0 bottom, 1 right, 2 top, 3 left).
CASES = ((), (3, 0), (0, 1), (3, 1), (1, 2), (3, 0, 1, 2), (0, 2), (3, 2), (2, 3), (2, 0), (0, 1, 2, 3), (2, 1), (1, 3), (1, 0), (0, 3), ())


def plane_trace(sp: DataFrame, normal: Sequence[float], offset: float) -> DataFrame:
    """Line pieces where the plane dot(p, normal) = offset cuts the quads: grid coordinates and world positions of both ends.

    Quads that the plane can't reach are dropped by their corner range before the case is looked at.
    """
    q = quads(sp)
    ring = ("p00", "p10", "p11", "p01")
    f = [sum((F.col(f"{p}.{c}") * n for c, n in zip(XYZ, normal, strict=True)), F.lit(0.0)) - offset for p in ring]
    q = q.select("*", *(e.alias(f"f{k}") for k, e in enumerate(f)))
    q = q.where("greatest(f0, f1, f2, f3) > 0 and least(f0, f1, f2, f3) <= 0")
    case = sum((F.when(F.col(f"f{k}") > 0, 1 << k).otherwise(0) for k in range(4)), F.lit(0))
    gi, gj = (0, 1, 1, 0), (0, 0, 1, 1)

    def edge(e: int) -> Column:
        a, b = e, (e + 1) % 4
        t = F.col(f"f{a}") / (F.col(f"f{a}") - F.col(f"f{b}"))
        t = F.when(F.col(f"f{a}") == F.col(f"f{b}"), 0.5).otherwise(t)
        mix = lambda u, v: u + (v - u) * t
        return F.struct(mix(F.col("i") + gi[a], F.col("i") + gi[b]).alias("gi"), mix(F.col("j") + gj[a], F.col("j") + gj[b]).alias("gj"), *(mix(F.col(f"{ring[a]}.{c}"), F.col(f"{ring[b]}.{c}")).alias(c) for c in XYZ))

    q = q.select(*CELL, case.alias("case"), *(edge(e).alias(f"e{e}") for e in range(4)))
    pieces = None
    for k, c in enumerate(CASES):
        found = [F.struct(F.lit(n // 2).alias("part"), F.col(f"e{c[n]}").alias("a"), F.col(f"e{c[n + 1]}").alias("b")) for n in range(0, len(c), 2)]
        if found:
            pieces = (F.when if pieces is None else pieces.when)(F.col("case") == k, F.array(*found))
    q = q.select(*CELL, F.explode(pieces).alias("s"))
    return q.select(*CELL, F.col("s.part").alias("part"), *(F.col(f"s.{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("gi", "gj", *XYZ)))


def transformed(sp: DataFrame, m: Sequence[Sequence[float]]) -> DataFrame:
    """Points under a 3 by 4 affine map."""
    return sp.select(*CELL, *((r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3]).alias(c) for r, c in zip(m, XYZ, strict=True)))


def bilinear(sp: DataFrame, at: DataFrame) -> DataFrame:
    """Surface positions at ``at(seg_id, u, v)`` grid coordinates (u along i); only where all four corners are valid."""
    key = at.withColumn("j", F.floor("v").cast("int")).withColumn("i", F.floor("u").cast("int"))
    q = quads(sp).join(key, list(CELL))
    fu, fv = F.col("u") - F.col("i"), F.col("v") - F.col("j")
    mix = lambda c: (1 - fv) * ((1 - fu) * F.col("p00." + c) + fu * F.col("p10." + c)) + fv * ((1 - fu) * F.col("p01." + c) + fu * F.col("p11." + c))
    return q.select("seg_id", "u", "v", *(mix(c).alias(c) for c in XYZ))


def spacing(sp: DataFrame) -> DataFrame:
    """Upper median (element n div 2) of the distance to the next point along i, for each segment."""
    n = around(sp, {"p": (0, 0), "r": (0, 1)}).where("p is not null and r is not null")
    return ranked(n.select("seg_id", length(sub("r", "p")).alias("spacing")), ["seg_id"], "spacing", "n div 2")
