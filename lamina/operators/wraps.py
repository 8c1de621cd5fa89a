"""The sheet next to a surface, and what a surface has in common with others.

``adjacent_wrap`` casts a ray along each cell's normal through a volume of distances to sheets: it must
leave the own sheet before the first least distance counts. ``membership`` finds the donor quad nearest
to each cell and where on the donor's grid the nearest point lies; where that jumps between neighbours
the donor is folded there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators import sampling
from lamina.operators.surface import CELL, XYZ, around, cross, length, quads, sub
from lamina.session import cut

FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))
#: A ray's share of the gap to be left behind and its least, its length in gaps, the distance that counts as a sheet.
CLEAR_SHARE, LEAST_CLEAR, RAY, ON_SHEET = 0.35, 2.5, 2.2, 2.0
#: Confidences of cast and of interpolated cells.
CAST, FILLED = 0.9, 0.4
#: How near a donor must be, the jump of grid places that is a fold, the agreement of windings.
PULL, JUMP, AGREEMENT = 8.0, 4.0, 0.3


def central_normals(cells: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Unit normals of the cells with all four neighbours."""
    n = around(cells, {"p": (0, 0), "r": (0, 1), "l": (0, -1), "d": (1, 0), "u": (-1, 0)}, extra).dropna(subset=["p", "r", "l", "d", "u"])
    m = cross(sub("r", "l"), sub("d", "u"))
    return n.where(length(m) >= 1e-9).select(*CELL, *(F.col(f"p.{c}").alias(c) for c in (*XYZ, *extra)), *((a / length(m)).alias("n" + c) for a, c in zip(m, XYZ, strict=True)))


def first_sheet(samples: Column, clear: Column) -> Column:
    """The step before which a ray's distances, structs (step, value) in order, are least for the first time after they passed ``clear``; null where they never are."""
    far = F.lit(1e30)
    start = F.struct(F.lit(False).alias("out"), far.alias("prev"), far.alias("before"), F.lit(None).cast("double").alias("hit"))

    def advance(s: Column, x: Column) -> Column:
        out = s["out"] | (x["value"] > clear)
        found = s["hit"].isNull() & out & (s["before"] > s["prev"]) & (x["value"] >= s["prev"]) & (s["prev"] < ON_SHEET)
        return F.struct(out.alias("out"), x["value"].alias("prev"), s["prev"].alias("before"), F.when(found, x["step"] - 1.0).otherwise(s["hit"]).alias("hit"))

    return F.aggregate(samples, start, advance, lambda s: s["hit"])


def adjacent_wrap(cells: DataFrame, distance: DataFrame, shape: Sequence[int], gap: Column, side: int = 1, rounds: int = 48) -> DataFrame:
    """The wrap outside (``side`` 1) or inside (-1) of the surface ``cells(seg_id, j, i, x, y, z)``: positions, ``kind`` (1 cast, 3 filled) and ``conf``.

    ``distance(z, y, x, v)`` are distances to the nearest sheet in a volume of ``shape``, where rays end; ``gap`` is the distance of sheets at a cell.
    Cells whose ray meets no sheet get the mean offset of two or more neighbours that have one, round by
    round, each from the state before it; the rest stay out.
    """
    cells = cells.select(*CELL, *XYZ, gap.alias("g"))
    rays = cut(central_normals(cells, ("g",)))
    at = rays.withColumn("step", F.explode(F.sequence(F.lit(1), F.floor(RAY * F.col("g")).cast("int"))))
    points = at.where("step >= 1").select(F.struct(*CELL, "step").alias("pt_id"), *((F.col(c) + side * F.col("step") * F.col("n" + c)).alias(c) for c in XYZ))
    for c, n in zip(XYZ, reversed(shape), strict=True):
        points = points.where(F.col(c).between(0, n - 1))
    seen = sampling.trilinear(points, distance).select("pt_id.*", "value")
    line = seen.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct(F.col("step").cast("double").alias("step"), "value"))).alias("s"))  # a ray's few steps
    cast = rays.join(line, list(CELL)).withColumn("hit", first_sheet(F.col("s"), F.greatest(CLEAR_SHARE * F.col("g"), F.lit(LEAST_CLEAR)))).where("hit > 0")
    now = cut(cast.select(*CELL, *((side * F.col("hit") * F.col("n" + c)).alias("o" + c) for c in XYZ), F.lit(1).alias("kind")))
    for _ in range(rounds):
        o = F.explode(F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in FOUR)))
        sent = now.select("seg_id", "j", "i", *("o" + c for c in XYZ), o.alias("o")).select("seg_id", (F.col("j") + F.col("o.dj")).alias("j"), (F.col("i") + F.col("o.di")).alias("i"), *("o" + c for c in XYZ))
        mean = sent.groupBy(*CELL).agg(*(F.avg("o" + c).alias("o" + c) for c in XYZ), F.count("*").alias("n")).where("n >= 2")
        new = cut(mean.join(cells.select(*CELL), list(CELL), "left_semi").join(now.select(*CELL), list(CELL), "left_anti").select(*CELL, *("o" + c for c in XYZ), F.lit(3).alias("kind")))
        if new.isEmpty():
            break
        now = cut(now.union(new))
    return cells.join(now, list(CELL)).select(*CELL, *((F.col(c) + F.col("o" + c)).alias(c) for c in XYZ), "kind", F.when(F.col("kind") == 1, CAST).otherwise(FILLED).alias("conf"))


def closest_on_triangle(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances of points to triangles, row by row, and the nearest point as shares of b - a and c - a: on the sides, or the foot on the plane where that is inside."""
    ab, ac, ap = b - a, c - a, p - a
    d = lambda u, v: (u * v).sum(1)
    share = lambda u, v: np.clip(np.divide(d(v, u), d(u, u), out=np.zeros(len(u)), where=d(u, u) > 0), 0, 1)
    t0, t1, t2 = share(ab, ap), share(ac, ap), share(c - b, p - b)
    det = d(ab, ab) * d(ac, ac) - d(ab, ac) ** 2
    safe = np.where(det > 1e-18, det, 1)
    s, t = (d(ac, ac) * d(ab, ap) - d(ab, ac) * d(ac, ap)) / safe, (d(ab, ab) * d(ac, ap) - d(ab, ac) * d(ab, ap)) / safe
    inside = (det > 1e-18) & (s >= 0) & (t >= 0) & (s + t <= 1)
    ways = [(t0, np.zeros(len(p))), (np.zeros(len(p)), t1), (1 - t2, t2)]
    far = [((ap - x[:, None] * ab - y[:, None] * ac) ** 2).sum(1) for x, y in ways]
    k = np.argmin(far, 0)
    pick = lambda at: np.choose(k, at)
    x, y = np.where(inside, s, pick([w[0] for w in ways])), np.where(inside, t, pick([w[1] for w in ways]))
    return ((ap - x[:, None] * ab - y[:, None] * ac) ** 2).sum(1), x, y


def nearest_place(points: DataFrame, donors: DataFrame, reach: float) -> DataFrame:
    """Of each point (pt_id, x, y, z) with a donor quad within ``reach``: ``d2``, the donor's ``seg_id`` and the place (u along i, v along j) of the nearest point; ties by key.

    A quad is sent to every hash cell its grown box meets, a point to its own cell.
    """
    q = quads(donors)
    for c in XYZ:
        corners = [F.col(f"{p}.{c}") for p in ("p00", "p10", "p01", "p11")]
        q = q.withColumn("c" + c, F.explode(F.sequence(F.floor((F.least(*corners) - reach) / reach), F.floor((F.greatest(*corners) + reach) / reach))))

    @F.arrow_udf("struct<d2: double, u: double, v: double>")
    def place(*columns: pa.Array) -> pa.Array:
        m = np.stack([np.asarray(c) for c in columns], 1)
        p, p00, p10, p01, p11 = (m[:, k : k + 3] for k in range(0, 15, 3))
        one, two = closest_on_triangle(p, p00, p10, p01), closest_on_triangle(p, p11, p01, p10)
        first = one[0] <= two[0]
        return pa.StructArray.from_arrays([pa.array(np.where(first, one[0], two[0])), pa.array(np.where(first, one[1], 1 - two[1])), pa.array(np.where(first, one[2], 1 - two[2]))], ["d2", "u", "v"])

    pair = points.select("pt_id", *XYZ, *(F.floor(F.col(c) / reach).alias("c" + c) for c in XYZ)).join(q, ["c" + c for c in XYZ])
    found = pair.select("pt_id", "seg_id", "j", "i", place(*XYZ, *(f"{k}.{c}" for k in ("p00", "p10", "p01", "p11") for c in XYZ)).alias("s")).where(F.col("s.d2") <= reach * reach)
    best = found.groupBy("pt_id").agg(F.min(F.struct(F.col("s.d2").alias("d2"), "seg_id", "j", "i", F.col("s.u").alias("u"), F.col("s.v").alias("v"))).alias("s"))
    return best.select("pt_id", F.col("s.d2").alias("d2"), F.col("s.seg_id").alias("seg_id"), (F.col("s.i") + F.col("s.u")).alias("u"), (F.col("s.j") + F.col("s.v")).alias("v"))


def membership(cells: DataFrame, donors: DataFrame, reach: float = PULL, jump: float = JUMP) -> DataFrame:
    """Of every cell ``donor``, the segment of ``donors`` that it lies on (-1: none within ``reach``; -2: its place jumps by more than ``jump`` against a neighbour on the same donor), ``u`` and ``v``."""
    near = nearest_place(cells.select(F.struct(*CELL).alias("pt_id"), *XYZ), donors, reach)
    own = cut(near.select("pt_id.*", F.col("seg_id").alias("donor"), "u", "v").select(F.col("seg_id"), "j", "i", "donor", "u", "v"))
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in FOUR)))
    sent = own.select("seg_id", "j", "i", F.col("donor").alias("d"), F.col("u").alias("nu"), F.col("v").alias("nv"), o.alias("o"))
    sent = sent.select("seg_id", (F.col("j") + F.col("o.dj")).alias("j"), (F.col("i") + F.col("o.di")).alias("i"), "d", "nu", "nv")
    far = (F.col("d") == F.col("donor")) & ((F.col("u") - F.col("nu")) ** 2 + (F.col("v") - F.col("nv")) ** 2 > jump * jump)
    folded = own.join(sent, list(CELL)).where(far).select(*CELL, F.lit(True).alias("fold")).distinct()
    out = cells.select(*CELL).join(own, list(CELL), "left").join(folded, list(CELL), "left")
    return out.select(*CELL, F.when(F.col("donor").isNull(), -1).when(F.col("fold"), -2).otherwise(F.col("donor")).cast("int").alias("donor"), F.col("donor").alias("nearest"), "u", "v")


def fused(cells: DataFrame, donors: DataFrame, reach: float = PULL) -> DataFrame:
    """Membership with the donor's own position (``dx, dy, dz``, bilinear; null where a corner is missing) and ``agrees``: whether the cell's ``wind`` is the donor's, shifted by
    the upper median of their differences over that donor's members, within ``AGREEMENT``. ``cells`` and ``donors`` have ``wind``."""
    from lamina.operators.solve import donor_offsets

    m = cut(membership(cells, donors, reach))
    at = m.where("donor >= 0").select(F.col("seg_id").alias("own"), F.col("j").alias("oj"), F.col("i").alias("oi"), F.col("donor").alias("seg_id"), "u", "v").withColumn("j", F.floor("v").cast("int")).withColumn("i", F.floor("u").cast("int"))
    q = quads(donors.select(*CELL, *XYZ, "wind"), ("wind",)).join(at, list(CELL))
    fu, fv = F.col("u") - F.col("i"), F.col("v") - F.col("j")
    mix = lambda c: (1 - fv) * ((1 - fu) * F.col("p00." + c) + fu * F.col("p10." + c)) + fv * ((1 - fu) * F.col("p01." + c) + fu * F.col("p11." + c))
    on = cut(q.select(F.col("own").alias("seg_id"), F.col("oj").alias("j"), F.col("oi").alias("i"), *(mix(c).alias("d" + c) for c in XYZ), mix("wind").alias("dwind")))
    both = m.join(on, list(CELL), "left").join(cells.select(*CELL, "wind"), list(CELL))
    offset = cut(donor_offsets(both.where("dwind is not null").select(F.col("donor").alias("donor_id"), F.col("wind").alias("cell_wind"), F.col("dwind").alias("donor_wind"))))
    out = both.join(offset.select("donor_id", "offset"), F.col("donor") == F.col("donor_id"), "left")
    return out.select(*CELL, "donor", "u", "v", "dx", "dy", "dz", (F.abs(F.col("wind") - F.col("dwind") - F.col("offset")) <= AGREEMENT).alias("agrees"))
