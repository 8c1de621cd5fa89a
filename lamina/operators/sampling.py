"""Samples of a volume at points, and resampling through affine maps.

A sample is an equi-join of taps with voxels and an aggregation by point. Taps carry the point's
key only, so a point costs eight small rows; absent voxels read 0 and add nothing, which makes the
join an inner one. An affine map is twelve literals in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.volume import ZYX, dense_grid

XYZ = ("x", "y", "z")


def nearest(points: DataFrame, v: DataFrame, scale: int = 1) -> DataFrame:
    """Value of the voxel that each point (pt_id, x, y, z) is in, at a level of that scale; 0 where there is none."""
    key = points.select("pt_id", *(F.floor(F.col(c) / scale).cast("int").alias(c) for c in XYZ))
    return key.join(v, list(ZYX), "left").select("pt_id", F.coalesce("v", F.lit(0)).cast("int").alias("v"))


def taps(points: DataFrame, scale: int = 1) -> DataFrame:
    """Eight taps of each point: voxel indices, the weight ``w``, and its derivatives ``wx``, ``wy``, ``wz``."""
    base = points.select("pt_id", *(F.floor(F.col(c) / scale).cast("int").alias("i" + c) for c in XYZ), *((F.col(c) / scale - F.floor(F.col(c) / scale)).alias("t" + c) for c in XYZ))
    one = lambda c, d: F.col("t" + c) if d else 1 - F.col("t" + c)
    sign = lambda d: F.lit(1.0 if d else -1.0)
    every = []
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                wx, wy, wz = one("x", dx), one("y", dy), one("z", dz)
                every.append(F.struct((F.col("iz") + dz).alias("z"), (F.col("iy") + dy).alias("y"), (F.col("ix") + dx).alias("x"), (wx * wy * wz).alias("w"), (sign(dx) * wy * wz).alias("wx"), (wx * sign(dy) * wz).alias("wy"), (wx * wy * sign(dz)).alias("wz")))
    return base.select("pt_id", F.inline(F.array(*every)))


def _corners(v: DataFrame) -> DataFrame:
    """The eight voxels ``c0`` to ``c7`` (x changes fastest) from each place (iz, iy, ix) on, absent ones 0: a row where one of them is stored."""
    each = [(dz, dy, dx) for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)]
    sent = v.select(F.inline(F.array(*(F.struct(*((F.col(c) - d).cast("int").alias("i" + c) for c, d in zip(ZYX, at, strict=True)), F.lit(k).alias("k"), F.col("v").cast("double").alias("v")) for k, at in enumerate(each)))))
    return sent.groupBy("iz", "iy", "ix").agg(*(F.sum(F.when(F.col("k") == k, F.col("v")).otherwise(0.0)).alias(f"c{k}") for k in range(8)))


def trilinear(points: DataFrame, v: DataFrame, scale: int = 1) -> DataFrame:
    """Trilinear value and gradient (per base voxel) at each point; outside reads 0. A point meets its eight voxels as one row, so it is shuffled once."""
    at = points.select("pt_id", *(F.floor(F.col(c) / scale).cast("int").alias("i" + c) for c in XYZ), *((F.col(c) / scale - F.floor(F.col(c) / scale)).alias("t" + c) for c in XYZ))
    at = at.join(_corners(v), ["iz", "iy", "ix"], "left")
    one = lambda c, d: F.col("t" + c) if d else 1 - F.col("t" + c)
    out = {n: F.lit(0.0) for n in ("value", "gx", "gy", "gz")}
    for k in range(8):
        d = dict(zip(ZYX, (k >> 2, k >> 1 & 1, k & 1), strict=True))
        w, s = {c: one(c, d[c]) for c in XYZ}, {c: 1.0 if d[c] else -1.0 for c in XYZ}
        here = F.col(f"c{k}")
        out["value"] += w["x"] * w["y"] * w["z"] * here
        out["gx"] += s["x"] * w["y"] * w["z"] * here / scale
        out["gy"] += w["x"] * s["y"] * w["z"] * here / scale
        out["gz"] += w["x"] * w["y"] * s["z"] * here / scale
    return at.select("pt_id", *(F.coalesce(e, F.lit(0.0)).alias(n) for n, e in out.items()))


def clamped(points: DataFrame, v: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Trilinear values on a block whose edge voxels reach half a voxel out; 0 beyond."""
    edge = F.lit(True)
    for c, n in zip(XYZ, reversed(shape), strict=True):
        edge = edge & (F.col(c) >= -0.5) & (F.col(c) <= n - 0.5)
    t = taps(points.where(edge))
    for c, n in zip(XYZ, reversed(shape), strict=True):
        t = t.withColumn(c, F.least(F.lit(n - 1), F.greatest(F.lit(0), F.col(c))))
    s = t.join(v, list(ZYX)).groupBy("pt_id").agg(F.sum(F.col("w") * F.col("v")).alias("value"))
    return points.select("pt_id").join(s, "pt_id", "left").select("pt_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def affine(m: Sequence[Sequence[float]]) -> list[Column]:
    """x, y, z under a 3 by 4 map."""
    return [r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3] for r in m]


def resampled(moving: DataFrame, m: Sequence[Sequence[float]], shape: Sequence[int]) -> DataFrame:
    """The moving volume seen on a fixed grid through the map fixed to moving, rounded half up."""
    nz, ny, nx = shape
    key = (F.col("z") * ny + F.col("y")) * nx + F.col("x")
    grid = dense_grid(moving.sparkSession, shape).select(key.cast("long").alias("pt_id"), *(a.alias(c) for a, c in zip(affine(m), XYZ, strict=True)))
    s = trilinear(grid, moving)
    return s.select(F.expr(f"pt_id div {ny * nx}").cast("int").alias("z"), (F.expr(f"pt_id div {nx}") % ny).cast("int").alias("y"), (F.col("pt_id") % nx).cast("int").alias("x"), F.floor(F.col("value") + 0.5).cast("int").alias("v"))


def multiply(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> list[list[float]]:
    """The map that applies b, then a."""
    full = lambda m: np.vstack([np.asarray(m, float), [0, 0, 0, 1]])
    return (full(a) @ full(b))[:3].tolist()


def inverse(m: Sequence[Sequence[float]]) -> list[list[float]]:
    """The inverse map; an error if there is none."""
    a = np.asarray(m, float)
    if abs(np.linalg.det(a[:, :3])) < 1e-12:
        raise ValueError("the map has no inverse")
    r = np.linalg.inv(a[:, :3])
    return np.hstack([r, -r @ a[:, 3:]]).tolist()


def level_for(distance: Column, cone: float, base: float, levels: int) -> Column:
    """Level whose voxels match a cone's footprint at a distance: floor(log2(footprint / base)), within the levels."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest(distance * cone / base, F.lit(1.0)))), F.lit(0)), F.lit(levels - 1)).cast("int")


def fallback_rank(level: Column, desired: Column) -> Column:
    """Order in which other levels stand in: the desired one, coarser ones, then finer ones, nearest first."""
    return F.when(level >= desired, level - desired).otherwise(1000 + desired - level)


def layer_stack(surface: DataFrame, v: DataFrame, layers: int, flip: bool = False) -> DataFrame:
    """Samples along normals: ``surface(seg_id, j, i, x, y, z, nx, ny, nz)``; layer l is (l - (layers - 1) / 2) voxels out; truncated to 0..255."""
    out = surface.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
    d = F.col("layer") - (layers - 1) / 2
    key = F.struct("seg_id", "j", "i", (layers - 1 - F.col("layer") if flip else F.col("layer")).alias("layer"))
    pts = out.select(key.alias("pt_id"), *((F.col(c) + d * F.col("n" + c)).alias(c) for c in XYZ))
    s = trilinear(pts, v).select("pt_id.*", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("value") + 1e-9))).cast("int").alias("v"))
    return s
