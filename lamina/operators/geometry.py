"""Frames, rays, windows and triangle geometry, as expressions on columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import by_shuffle

XYZ = ("x", "y", "z")


def dot(a: Sequence, b: Sequence) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Sequence, b: Sequence) -> list:
    return [p - q for p, q in zip(a, b, strict=True)]


def cross(a: Sequence, b: Sequence) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def columns(prefix: str) -> list[Column]:
    return [F.col(prefix + c) for c in XYZ]


def plane_frame(normal: Sequence[float]) -> tuple[list[float], list[float], list[float]]:
    """Unit vectors u, v of a plane and its unit normal; u is level with the axis that the normal is furthest from."""
    size = sum(n * n for n in normal) ** 0.5
    n = [a / size for a in normal]
    k = min(range(3), key=lambda i: (abs(n[i]), i))
    e = [float(i == k) for i in range(3)]
    u = cross(e, n)
    size = sum(a * a for a in u) ** 0.5
    u = [a / size for a in u]
    return u, cross(n, u), n


def in_frame(points: DataFrame, origin: Sequence[float], frame: tuple) -> DataFrame:
    """Coordinates u, v, w of points in a plane's frame."""
    d = minus([F.col(c) for c in XYZ], origin)
    return points.select("pt_id", *(dot(d, [F.lit(a) for a in e]).alias(c) for e, c in zip(frame, "uvw", strict=True)))


def ray_box(origin: Sequence[Column], direction: Sequence[Column], lo: Sequence[float], hi: Sequence[float]) -> tuple[Column, Column]:
    """Where rays enter and leave a box; the entry is after the exit where they miss it. Directions aren't 0 on any axis."""
    near, far = [], []
    for o, d, a, b in zip(origin, direction, lo, hi, strict=True):
        near.append(F.least((a - o) / d, (b - o) / d))
        far.append(F.greatest((a - o) / d, (b - o) / d))
    return F.greatest(*near, F.lit(0.0)), F.least(*far)


def triangle_distance2(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of points to triangles (rows of 3): to the plane where the foot is inside, else to the nearest side."""

    def side(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        e, d = v - u, p - u
        e2 = (e * e).sum(1)
        t = np.clip(np.divide((d * e).sum(1), e2, out=np.zeros(len(e2)), where=e2 > 0), 0, 1)
        r = d - t[:, None] * e
        return (r * r).sum(1)

    n = np.cross(b - a, c - a)
    n2 = (n * n).sum(1)
    inside = n2 > 1e-18
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(v - u, p - u) * n).sum(1) >= 0
    h = ((p - a) * n).sum(1)
    edge = np.minimum(np.minimum(side(a, b), side(b, c)), side(c, a))
    return np.where(inside, np.divide(h * h, n2, out=np.zeros(len(n2)), where=n2 > 0), edge)


def segment_hits_triangle(p: Sequence, q: Sequence, a: Sequence, b: Sequence, c: Sequence) -> Column:
    """Whether the segment from p to q goes through a triangle (touching its border counts; one in its plane doesn't)."""
    d, e1, e2 = minus(q, p), minus(b, a), minus(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    s = minus(p, a)
    u = dot(s, h) / det
    k = cross(s, e1)
    v, t = dot(d, k) / det, dot(e2, k) / det
    return (F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0) & (t <= 1)


def nearest_surface(points: DataFrame, quads: DataFrame, reach: float) -> DataFrame:
    """Squared distance of each point (pt_id, x, y, z) to the nearest quad (seg_id, j, i, p00 .. p11 structs) within ``reach``, and the quad; ties by key.

    A quad is sent to every hash cell its grown box meets, a point to its own cell.
    """
    q = quads
    for c in XYZ:
        corners = [F.col(f"{p}.{c}") for p in ("p00", "p10", "p01", "p11")]
        q = q.withColumn("c" + c, F.explode(F.sequence(F.floor((F.least(*corners) - reach) / reach), F.floor((F.greatest(*corners) + reach) / reach))))
    p = points.select("pt_id", *XYZ, *(F.floor(F.col(c) / reach).alias("c" + c) for c in XYZ))

    @F.arrow_udf("double")
    def distance2(*columns: pa.Array) -> pa.Array:  # as column expressions this grows beyond what can be compiled
        v = np.stack([np.asarray(c) for c in columns], 1)
        at, p00, p10, p01, p11 = (v[:, k : k + 3] for k in range(0, 15, 3))
        return pa.array(np.minimum(triangle_distance2(at, p00, p10, p01), triangle_distance2(at, p11, p01, p10)))

    pair = p.join(by_shuffle(q), ["c" + c for c in XYZ])
    d2 = distance2(*XYZ, *(f"{k}.{c}" for k in ("p00", "p10", "p01", "p11") for c in XYZ))
    best = pair.select("pt_id", d2.alias("d2"), "seg_id", "j", "i").where(F.col("d2") <= reach * reach).select("pt_id", F.struct("d2", "seg_id", "j", "i").alias("s"))
    return best.groupBy("pt_id").agg(F.min("s").alias("s")).select("pt_id", "s.*")


def snapped(x: Column, n: int) -> Column:
    """Largest multiple of n that isn't above x."""
    return (F.floor(x / n) * n).cast("int")


def ring(x: Column, n: int) -> Column:
    """Place of a layer in a ring of n."""
    return F.pmod(x, F.lit(n)).cast("int")


def visible_bricks(bricks: DataFrame, edge: int, eye: Sequence[float], direction: Sequence[float], cosine: float, levels: int, cone: float) -> DataFrame:
    """Bricks (bz, by, bx) whose centre lies in a cone of view, with squared distance and the level that fits it."""
    from lamina.operators.sampling import level_for

    d = [(F.col("b" + c) + 0.5) * edge - e for c, e in zip(XYZ, eye, strict=True)]
    d2 = dot(d, d)
    ahead = dot(d, [F.lit(a) for a in direction])
    return bricks.where(ahead >= cosine * F.sqrt(d2)).select("bz", "by", "bx", d2.alias("d2"), level_for(F.sqrt(d2), cone, 1.0, levels).alias("level"))


def coarsest_that_fits(bricks: DataFrame, levels: int, most: int) -> DataFrame:
    """The finest level at which the bricks (of level 0) are at most ``most``, with their number; the coarsest if none is."""
    k = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    up = bricks.select("bz", "by", "bx", k.alias("level"))
    up = up.select("level", *(F.expr(f"shiftright({c}, level)").alias(c) for c in ("bz", "by", "bx"))).distinct().groupBy("level").agg(F.count("*").alias("n"))
    rank = F.when(F.col("n") <= most, F.col("level")).otherwise(1000 - F.col("level"))
    return up.agg(F.min_by(F.struct("level", "n"), rank).alias("s")).select("s.*")


def chunks_near(points: DataFrame, pad: float, edge: int) -> DataFrame:
    """Chunk keys (cz, cy, cx) that a box of ``pad`` around some surface point meets."""
    out = points
    for c in XYZ:
        out = out.withColumn("c" + c, F.explode(F.sequence(F.floor((F.col(c) - pad) / edge), F.floor((F.col(c) + pad) / edge))))
    return out.select("cz", "cy", "cx").where("cz >= 0 and cy >= 0 and cx >= 0").distinct()
