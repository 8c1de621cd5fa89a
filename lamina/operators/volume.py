"""Operators on volumes: ``voxel(z, y, x, v)`` rows, where an absent row stands for 0.

Box predicates are written on the plain key columns, so that on stored volumes (sorted by brick)
they reach the Parquet scan. Reductions are groupBy with partial aggregation; neighbourhoods are
made by ``stencil.spread``, an explode of offsets and an equi-aggregation, never a theta join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZYX = ("z", "y", "x")


def half(c: str, by: int = 2) -> Column:
    """Index of the block of ``by`` that a non-negative index is in."""
    return F.expr(f"{c} div {by}").cast("int").alias(c)


def dense_grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Every (z, y, x) of a shape, from one distributed range."""
    nz, ny, nx = shape
    k = F.col("id")
    return spark.range(nz * ny * nx).select(F.expr(f"id div {ny * nx}").cast("int").alias("z"), (F.expr(f"id div {nx}") % ny).cast("int").alias("y"), (k % nx).cast("int").alias("x"))


def dense(v: DataFrame, shape: Sequence[int]) -> DataFrame:
    """All voxels of a shape, absent ones with 0."""
    return dense_grid(v.sparkSession, shape).join(v, list(ZYX), "left").select(*ZYX, F.coalesce("v", F.lit(0)).cast("int").alias("v"))


def at(v: DataFrame, z: int, y: int, x: int) -> DataFrame:
    """One voxel; no row where it is absent."""
    return v.where((F.col("z") == z) & (F.col("y") == y) & (F.col("x") == x))


def box(v: DataFrame, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """Voxels with lo <= index < hi on each axis."""
    cond = F.lit(True)
    for c, a, b in zip(ZYX, lo, hi, strict=True):
        cond = cond & (F.col(c) >= a) & (F.col(c) < b)
    return v.where(cond)


def region(v: DataFrame, lo: Sequence[int], size: Sequence[int]) -> DataFrame:
    """A dense block that may reach outside the volume: what isn't there reads 0."""
    hi = [a + n for a, n in zip(lo, size, strict=True)]
    moved = box(v, lo, hi).select(*((F.col(c) - a).cast("int").alias(c) for c, a in zip(ZYX, lo, strict=True)), "v")
    return dense(moved, size).select(*((F.col(c) + a).cast("int").alias(c) for c, a in zip(ZYX, lo, strict=True)), "v")


def low_cut(v: DataFrame, least: int) -> DataFrame:
    """Values under ``least`` become 0."""
    return v.withColumn("v", F.when(F.col("v") >= least, F.col("v")).otherwise(0))


def pyramid_mean(v: DataFrame, rounded: bool = True) -> DataFrame:
    """2x2x2 box mean with absent children as 0: (sum + 4) div 8, or sum div 8."""
    return v.groupBy(*(half(c) for c in ZYX)).agg(F.expr(f"(sum(v) + {4 if rounded else 0}) div 8").cast("int").alias("v"))


def pyramid(v: DataFrame, levels: int, rounded: bool = True) -> DataFrame:
    """Levels 1 to ``levels``, each made of the one before; a column ``level`` is added."""
    out, now = None, v
    for k in range(1, levels + 1):
        now = pyramid_mean(now, rounded)
        part = now.select(F.lit(k).alias("level"), *ZYX, "v")
        out = part if out is None else out.union(part)
    return out


def gradient_weighted_mean(v: DataFrame, shape: Sequence[int]) -> DataFrame:
    """2x2x2 mean with weights 1 + 9/255 times the gradient's length inside the octant (one-sided differences at its seams)."""
    d = dense(v, shape)
    keys = [half(c) for c in ZYX]
    corner = {c: (F.col(c) % 2).alias("p" + c) for c in ZYX}
    cells = d.groupBy(*keys).agg(*(F.max(F.when((corner["z"] == a) & (corner["y"] == b) & (corner["x"] == c), F.col("v"))).cast("double").alias(f"c{a}{b}{c}") for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    total, weight = F.lit(0.0), F.lit(0.0)
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                here = F.col(f"c{a}{b}{c}")
                g = F.pow(F.col(f"c{1 - a}{b}{c}") - here, 2) + F.pow(F.col(f"c{a}{1 - b}{c}") - here, 2) + F.pow(F.col(f"c{a}{b}{1 - c}") - here, 2)
                w = 1 + F.sqrt(g) * (9.0 / 255)
                total, weight = total + w * here, weight + w
    return cells.select(*ZYX, F.floor(total / weight + 0.5).cast("int").alias("v"))


def plane_mean(v: DataFrame, n: int) -> DataFrame:
    """n by n mean of each z plane, truncated; blocks at an edge are divided by the rows they have."""
    return v.groupBy("z", half("y", n), half("x", n)).agg(F.expr("sum(v) div count(*)").cast("int").alias("v"))


def block_max(v: DataFrame, n: int = 8) -> DataFrame:
    """Largest value of each n**3 block."""
    return v.groupBy(*(half(c, n) for c in ZYX)).agg(F.max("v").alias("v"))


def brick_summary(v: DataFrame, n: int = 8) -> DataFrame:
    """Least, largest and number of non-zero values of each n**3 brick."""
    return v.groupBy(*(half(c, n) for c in ZYX)).agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.count_if(F.col("v") > 0).alias("n_nonzero"))


def seen_chunks(v: DataFrame, chunk: int, levels: int) -> DataFrame:
    """Chunks that aren't air by the *largest* value of coarse voxels: a mean may round eight small values to 0."""
    coarse = v.groupBy(*(half(c, 2**levels) for c in ZYX)).agg(F.max("v").alias("v")).where("v > 0")
    return coarse.select(*(half(c, chunk // 2**levels) for c in ZYX)).distinct()


def projection(v: DataFrame, how: str = "max") -> DataFrame:
    """Accumulation along z for each (y, x): largest value, number of samples, and first z with a value over 12."""
    return v.groupBy("y", "x").agg(F.max("v").alias("mip"), F.count("*").alias("steps"), F.min(F.when(F.col("v") > 12, F.col("z"))).alias("depth"))


def slab(v: DataFrame, normal: Sequence[int], lo: int, hi: int) -> DataFrame:
    """Voxels with lo <= dot(position, normal) < hi, for a slice of any direction; normal is in (x, y, z)."""
    d = F.col("x") * normal[0] + F.col("y") * normal[1] + F.col("z") * normal[2]
    return v.where((d >= lo) & (d < hi)).withColumn("d", d)


def composite(v: DataFrame, cut: float = 0.98) -> DataFrame:
    """Front-to-back compositing along z: opacity v/255 of each sample, and nothing after the opacity so far passes ``cut``.

    The samples of a ray are folded in order; a ray holds at most the volume's depth.
    """
    ray = v.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("z", "v"))).alias("s"))
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("a"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        alpha = s["v"] / 255.0
        go = acc["a"] < cut
        return F.struct(
            F.when(go, acc["c"] + (1 - acc["a"]) * alpha * s["v"]).otherwise(acc["c"]).alias("c"),
            F.when(go, acc["a"] + (1 - acc["a"]) * alpha).otherwise(acc["a"]).alias("a"),
            (acc["n"] + go.cast("int")).alias("n"),
        )

    return ray.select("y", "x", F.aggregate("s", zero, step).alias("r")).select("y", "x", F.col("r.c").alias("color"), F.col("r.a").alias("alpha"), F.col("r.n").alias("n"))


def shaded(v: DataFrame, tf: DataFrame, density: float, step: float, cut: float = 0.98) -> DataFrame:
    """Compositing along z through a transfer table of 256 rows: a sample's opacity is corrected for its length, 1 - (1 - a) ** (density * step), and nothing
    after the opacity so far passes ``cut`` counts; colours ``r``, ``g``, ``b`` and ``alpha`` from 0 to 1."""
    alpha = 1 - F.pow(1 - F.col("a") / 255.0, F.lit(density * step))
    sample = v.select("y", "x", "z", "v").join(F.broadcast(tf), "v")
    ray = sample.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("z", alpha.alias("a"), *((F.col(c) / 255.0).alias(c) for c in "rgb")))).alias("s"))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("r", "g", "b", "a")), F.lit(0).alias("n"))

    def fold(acc: Column, s: Column) -> Column:
        go = acc["a"] < cut
        part = F.when(go, (1 - acc["a"]) * s["a"]).otherwise(0.0)
        return F.struct(*((acc[c] + part * s[c]).alias(c) for c in "rgb"), (acc["a"] + part).alias("a"), (acc["n"] + go.cast("int")).alias("n"))

    return ray.select("y", "x", F.aggregate("s", zero, fold).alias("p")).select("y", "x", *(F.col("p." + c).alias(c) for c in "rgb"), F.col("p.a").alias("alpha"), F.col("p.n").alias("n"))


def transfer_table(spark: SparkSession, points: Sequence[tuple[int, int, int, int, int]]) -> DataFrame:
    """``tf(v, r, g, b, a)`` of 256 rows: integer-linear between control points (value, r, g, b, a), flat outside."""
    lo = spark.createDataFrame([(*p, *q) for p, q in zip(points, points[1:], strict=False)], "v0 int, r0 int, g0 int, b0 int, a0 int, v1 int, r1 int, g1 int, b1 int, a1 int")
    every = spark.range(256).select(F.col("id").cast("int").alias("v"))
    first, last = points[0], points[-1]
    inside = every.join(F.broadcast(lo), (F.col("v") >= F.col("v0")) & (F.col("v") < F.col("v1")))
    mix = [F.expr(f"({c}0 * (v1 - v) + {c}1 * (v - v0)) div (v1 - v0)").cast("int").alias(c) for c in "rgba"]
    ends = every.where((F.col("v") < first[0]) | (F.col("v") >= last[0]))
    flat = [F.when(F.col("v") < first[0], first[k + 1]).otherwise(last[k + 1]).cast("int").alias(c) for k, c in enumerate("rgba")]
    return inside.select("v", *mix).union(ends.select("v", *flat))


def least_visible(tf: DataFrame) -> DataFrame:
    """First value with an opacity; 255 if there is none."""
    return tf.agg(F.coalesce(F.min(F.when(F.col("a") > 0, F.col("v"))), F.lit(255)).alias("v"))
