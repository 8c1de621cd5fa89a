"""Neighbourhood operators on volumes.

Small neighbourhoods are made by sending every stored voxel to the centres it belongs to (``spread``)
and aggregating by centre, with partial aggregation; separable maxima go axis by axis. Larger ones
go by blocks (``by_blocks``): a voxel is sent to the blocks whose core, grown by a halo, it is in,
1 + 2 halo / core copies an axis on average, and each block is one small dense array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.graph import least_of_component
from lamina.operators.volume import ZYX, dense, dense_grid
from lamina.session import cut


#: Voxels along the side of a block's core.
CORE = 16
#: Corners of a tetrahedron around a voxel.
TETRAHEDRON = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]


def spread(v: DataFrame, offsets: Sequence[Sequence[int]], shape: Sequence[int] | None = None) -> DataFrame:
    """Each voxel once for each centre whose neighbourhood it is in: columns z, y, x of the centre, ``dz``, ``dy``, ``dx`` and the voxel's others."""
    o = F.array(*(F.struct(*(F.lit(int(k)).alias("d" + c) for c, k in zip(ZYX, d, strict=True))) for d in offsets))
    rest = [c for c in v.columns if c not in ZYX]
    out = v.select(*ZYX, *rest, F.explode(o).alias("o"))
    out = out.select(*((F.col(c) - F.col("o.d" + c)).cast("int").alias(c) for c in ZYX), *(F.col("o.d" + c).alias("d" + c) for c in ZYX), *rest)
    if shape is None:
        return out
    cond = F.lit(True)
    for c, n in zip(ZYX, shape, strict=True):
        cond = cond & (F.col(c) >= 0) & (F.col(c) < n)
    return out.where(cond)


def cube(r: int) -> list[tuple[int, int, int]]:
    k = range(-r, r + 1)
    return [(a, b, c) for a in k for b in k for c in k]


def by_blocks(v: DataFrame, shape: Sequence[int], halo: int, run: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str, clamp: bool = True, core: int = CORE, only: bool = False) -> DataFrame:
    """``z``, ``y``, ``x`` and ``columns`` of every voxel of a shape (``only``: of blocks that some voxel reaches): ``run`` gets a block's values with a halo
    and returns arrays of the core; beyond the volume a halo repeats its edge (``clamp``) or reads 0."""
    blocks = [-(-n // core) for n in shape]
    sent = v.select(*ZYX, F.col("v").cast("int").alias("v"))
    for c, n in zip(ZYX, blocks, strict=True):
        first = F.greatest(F.lit(0), F.floor((F.col(c) - halo) / core)).cast("int")
        last = F.least(F.lit(n - 1), F.floor((F.col(c) + halo) / core)).cast("int")
        sent = sent.withColumn("b" + c, F.explode(F.sequence(first, last)))
    if not only:
        every = dense_grid(v.sparkSession, blocks)
        sent = sent.union(every.select(*(F.lit(None).cast("int") for _ in range(4)), *ZYX))
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"int": "int32", "long": "int64", "double": "float64"}

    def block(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lo = [max(0, k * core - halo) for k in key]
        hi = [min(n, (k + 1) * core + halo) for k, n in zip(key, shape, strict=True)]
        own = [min(core, n - k * core) for k, n in zip(key, shape, strict=True)]
        a = np.zeros([q - p for p, q in zip(lo, hi, strict=True)], np.int32)
        g = g[g["v"].notna()].astype({c: "int64" for c in (*ZYX, "v")})
        a[g["z"] - lo[0], g["y"] - lo[1], g["x"] - lo[2]] = g["v"]
        room = [(halo - (k * core - p), halo - (q - (k * core + n))) for k, p, q, n in zip(key, lo, hi, own, strict=True)]
        out = run(np.pad(a, room, mode="edge" if clamp else "constant"))
        z, y, x = (i.ravel() + k * core for i, k in zip(np.indices(own), key, strict=True))
        return pd.DataFrame({"z": z.astype("int32"), "y": y.astype("int32"), "x": x.astype("int32")} | {n: out[n].ravel().astype(kinds[c.split()[1]]) for n, c in zip(names, columns.split(", "), strict=True)})

    return sent.groupBy("bz", "by", "bx").applyInPandas(block, f"z int, y int, x int, {columns}")


def _around(a: np.ndarray, r: int) -> np.ndarray:
    """The (2r+1)**3 values around each inner element, last."""
    w = np.lib.stride_tricks.sliding_window_view(a, (2 * r + 1,) * 3)
    return w.reshape(*w.shape[:3], -1)


def median(v: DataFrame, r: int, shape: Sequence[int]) -> DataFrame:
    """Median over (2r+1)**3, clamped to the brick."""
    n = (2 * r + 1) ** 3
    return by_blocks(v, shape, r, lambda a: {"v": np.partition(_around(a, r), n // 2, -1)[..., n // 2]}, "v int")


def unsharp(v: DataFrame, amount: int, shape: Sequence[int]) -> DataFrame:
    """v + amount * (v - mean of 27), clamped to 0..255, in whole numbers: (27 v + amount (27 v - sum)) div 27."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        own = a[1:-1, 1:-1, 1:-1]
        return {"v": np.clip((27 * own + amount * (27 * own - _around(a, 1).sum(-1))) // 27, 0, 255)}

    return by_blocks(v, shape, 1, run, "v int")


def max_pool(v: DataFrame, r: int, shape: Sequence[int]) -> DataFrame:
    """Largest value over (2r+1)**3, one axis after the other."""
    out = dense(v, shape)
    for k in range(3):
        off = [tuple(d if a == k else 0 for a in range(3)) for d in range(-r, r + 1)]
        out = spread(out, off, shape).groupBy(*ZYX).agg(F.max("v").alias("v"))
    return out


def gradient(v: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Central differences g = v(+1) - v(-1) on each axis; outside reads 0."""
    off = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    one = lambda c: F.coalesce(F.sum(F.col("v") * F.col("d" + c)), F.lit(0)).cast("int").alias("g" + c)
    g = spread(v, off, shape).groupBy(*ZYX).agg(*(one(c) for c in ZYX))
    return dense_grid(v.sparkSession, shape).join(g, list(ZYX), "left").select(*ZYX, *(F.coalesce("g" + c, F.lit(0)).cast("int").alias("g" + c) for c in ZYX))


FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def boundary(solid: DataFrame) -> DataFrame:
    """Solid voxels with a void 6-neighbour: fewer than six solid ones send themselves there."""
    near = spread(solid.select(*ZYX), FACES).groupBy(*ZYX).agg(F.count("*").alias("n"))
    return solid.select(*ZYX).join(near, list(ZYX), "left").where(F.coalesce("n", F.lit(0)) < 6).select(*ZYX)


def tetrahedral_gradient(v: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Gradient by four taps at the corners of a tetrahedron: the sum of each corner's direction times its value; outside reads 0."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        n = [k - 2 for k in a.shape]
        tap = lambda d: a[tuple(slice(1 + k, 1 + k + m) for k, m in zip(d, n, strict=True))].astype(np.int64)
        return {"g" + c: sum(d[k] * tap(d) for d in TETRAHEDRON) for k, c in enumerate(ZYX)}

    return by_blocks(v, shape, 1, run, "gz int, gy int, gx int", clamp=False)


def outward_normal(solid: DataFrame, at: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Mean unit direction to void voxels within 5**3: the sum over all directions is 0, so it is minus the sum to solid ones."""
    off = [o for o in cube(2) if o != (0, 0, 0)]

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        n = [k - 4 for k in a.shape]
        out = {c: np.zeros(n) for c in ("nz", "ny", "nx", "n_solid")}
        for d in off:
            near = a[tuple(slice(2 + k, 2 + k + m) for k, m in zip(d, n, strict=True))]
            size = float(np.sqrt(sum(k * k for k in d)))
            for k, c in zip(d, ("nz", "ny", "nx"), strict=True):
                out[c] -= near * (k / size)
            out["n_solid"] += near
        size = np.sqrt(out["nz"] ** 2 + out["ny"] ** 2 + out["nx"] ** 2)
        for c in ("nz", "ny", "nx"):
            out[c] = np.where(size > 1e-9, out[c] / np.where(size > 1e-9, size, 1), 0.0)
        return out

    found = by_blocks(solid.select(*ZYX, F.lit(1).alias("v")), shape, 2, run, "nz double, ny double, nx double, n_solid long", clamp=False, only=True)
    return at.select(*ZYX).join(found, list(ZYX))


def occupancy(v: DataFrame, n: int, blocks: Sequence[int]) -> DataFrame:
    """Largest value of n**3 blocks, then of the 3**3 blocks around each."""
    from lamina.operators.volume import block_max

    return max_pool(block_max(v, n), 1, blocks)


def gap_fill(solid: DataFrame, axis: str, shape: Sequence[int], most: int = 2) -> DataFrame:
    """Void voxels of gaps of at most ``most`` between two solid ones along an axis; fills come from the state before filling."""
    rest = [c for c in ZYX if c != axis]
    nxt = F.lead(axis).over(Window.partitionBy(*rest).orderBy(axis))
    gap = solid.select(*ZYX).withColumn("e", nxt).where((F.col("e") - F.col(axis) > 1) & (F.col("e") - F.col(axis) <= most + 1))
    filled = F.explode(F.sequence(F.col(axis) + 1, F.col("e") - 1)).alias("f")
    return gap.select(*rest, filled).select(*(F.col("f").cast("int").alias(axis) if c == axis else F.col(c) for c in ZYX))


def _edt_lines(values: np.ndarray) -> np.ndarray:
    """Along the last axis: min over p of (q - p)**2 + f(p), exactly."""
    n = values.shape[-1]
    out = values.copy()
    for k in range(1, n):  # all pairs that are k apart
        np.minimum(out[..., k:], values[..., :-k] + k * k, out=out[..., k:])
        np.minimum(out[..., :-k], values[..., k:] + k * k, out=out[..., :-k])
    return out


def distance_transform(solid: DataFrame, shape: Sequence[int], core: int = 64, border: int = 16, clip: int = 255) -> DataFrame:
    """Squared distance to the nearest solid voxel within ``border`` of each core block, clipped; a block without any reads ``clip``. Blocks are independent, with a halo each: a voxel goes to 3.4 of them on average."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        f = np.where(a > 0, 0, 1 << 20).astype(np.int64)
        for k in range(3):
            f = np.moveaxis(_edt_lines(np.moveaxis(f, k, -1)), -1, k)
        return {"d2": np.minimum(f[tuple(slice(border, n - border) for n in f.shape)], clip)}

    return by_blocks(solid.select(*ZYX, F.lit(1).alias("v")), shape, border, run, "d2 int", clamp=False, core=core)


def links(voxels: DataFrame, shape: Sequence[int]) -> DataFrame:
    """``(u, v)``, numbers of 6-connected voxels, larger first."""
    number = (F.col("z").cast("long") * shape[1] + F.col("y")) * shape[2] + F.col("x")
    own = voxels.select(*ZYX, number.alias("n"))
    ahead = spread(own, FACES[1::2]).select(*ZYX, F.col("n").alias("v"))
    return own.join(ahead, list(ZYX)).select(F.col("n").alias("u"), "v")


def hysteresis(strong: DataFrame, weak: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Weak voxels 6-connected to strong ones over weak ones (strong ones too): components of voxels, of which those with a strong one stay."""
    every = cut(weak.select(*ZYX, F.lit(0).alias("s")).union(strong.select(*ZYX, F.lit(1).alias("s"))).groupBy(*ZYX).agg(F.max("s").alias("s")))
    number = (F.col("z").cast("long") * shape[1] + F.col("y")) * shape[2] + F.col("x")
    part = every.select(*ZYX, "s", number.alias("u")).join(least_of_component(links(every, shape)), "u", "left").select(*ZYX, "s", F.coalesce("v", "u").alias("c"))
    part = cut(part)
    good = cut(part.where("s = 1").select("c").distinct())
    return part.join(good, "c", "left_semi").select(*ZYX)


def weighted(column: str, weight: Column) -> Column:
    return F.sum(F.col(column) * weight) / F.sum(weight)
