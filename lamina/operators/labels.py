"""Sparse label volumes ``label(z, y, x, cls)``: class 0 isn't stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.volume import ZYX, half


def counts(lab: DataFrame) -> DataFrame:
    """Voxels of each class."""
    return lab.groupBy("cls").agg(F.count("*").alias("n"))


def ball(spark, centre: Sequence[float], radius: float, shape: Sequence[int]) -> DataFrame:
    """Voxels (x, y, z order of the centre) within a radius, inside the volume."""
    from math import ceil, floor

    lo = [max(0, ceil(c - radius)) for c in centre]
    hi = [min(n - 1, floor(c + radius)) for c, n in zip(centre, reversed(shape), strict=True)]
    size = [max(0, b - a + 1) for a, b in zip(lo, hi, strict=True)]
    k = spark.range(size[0] * size[1] * size[2])
    if not size[0] * size[1] * size[2]:
        return k.select(*(F.lit(0).alias(c) for c in ZYX)).where("false")
    b = k.select((F.expr(f"id div {size[0] * size[1]}") + lo[2]).cast("int").alias("z"), (F.expr(f"id div {size[0]}") % size[1] + lo[1]).cast("int").alias("y"), (F.col("id") % size[0] + lo[0]).cast("int").alias("x"))
    d = sum(((F.col(c) - p) * (F.col(c) - p) for c, p in zip("xyz", map(float, centre), strict=True)), F.lit(0.0))
    return b.where(d <= radius * radius)


def painted(lab: DataFrame, centre: Sequence[float], radius: float, cls: int, shape: Sequence[int]) -> DataFrame:
    """The labels after a ball is painted; class 0 erases."""
    b = ball(lab.sparkSession, centre, radius, shape)
    kept = lab.join(b, list(ZYX), "left_anti").select(*ZYX, "cls")
    return kept.union(b.select(*ZYX, F.lit(cls).alias("cls"))) if cls else kept


def changed(lab: DataFrame, centre: Sequence[float], radius: float, cls: int, shape: Sequence[int]) -> DataFrame:
    """How many voxels painting would change."""
    b = ball(lab.sparkSession, centre, radius, shape).join(lab, list(ZYX), "left")
    return b.agg(F.count_if(F.coalesce("cls", F.lit(0)) != cls).alias("changed"))


def level(lab: DataFrame, k: int) -> DataFrame:
    """A coarser level by stride: every 2**k-th voxel, not a majority."""
    keep = F.lit(True)
    for c in ZYX:
        keep = keep & (F.col(c) % 2**k == 0)
    return lab.where(keep).select(*(half(c, 2**k) for c in ZYX), "cls")


def tinted(v: DataFrame, lab: DataFrame) -> DataFrame:
    """Voxels with the label's tint: a third of the way from the value to 32 times the class."""
    j = v.join(lab, list(ZYX), "left")
    return j.select(*ZYX, F.when(F.col("cls").isNull(), F.col("v")).otherwise(F.expr("(2 * v + 32 * cls) div 3")).cast("int").alias("v"))


def overlaid(v: DataFrame, overlay: DataFrame, gain: float, colour: float) -> DataFrame:
    """Voxels drawn towards a colour by an overlay's value (0..255) times ``gain``, as a share of 1 at most; absent overlay voxels change nothing."""
    k = F.least(F.lit(1.0), F.coalesce(F.col("k"), F.lit(0)) / 255.0 * gain)
    return v.join(overlay.select(*ZYX, F.col("v").alias("k")), list(ZYX), "left").select(*ZYX, (F.col("v") + (F.lit(colour) - F.col("v")) * k).alias("v"))


def fused(fixed: DataFrame, moving: DataFrame, share: float, least: int = 0) -> DataFrame:
    """Two volumes in one picture, in whole hundredths: the fixed one is green, the moving one red and blue, mixed into the grey of the fixed one by ``share``;
    moving voxels under ``least``, and absent ones, are 0. What agrees stays grey."""
    j = fixed.select(*ZYX, F.col("v").alias("f")).join(moving.where(F.col("v") >= least).select(*ZYX, F.col("v").alias("m")), list(ZYX), "full")
    f, m = F.coalesce("f", F.lit(0)), F.coalesce("m", F.lit(0))
    side = F.floor((f + (m - f) * share) * 100 + 0.5).cast("long")
    return j.select(*ZYX, side.alias("r"), (f * 100).cast("long").alias("g"), side.alias("b"))


def dirty(lab: DataFrame, saved_gen: int, brick: int) -> DataFrame:
    """Bricks with an edit after ``saved_gen``, with the voxels each has left: those with none are to be deleted. Needs a column ``gen``."""
    return lab.groupBy(*(half(c, brick) for c in ZYX)).agg(F.max("gen").alias("gen"), F.count_if(F.col("cls") > 0).alias("n")).where(F.col("gen") > saved_gen)
