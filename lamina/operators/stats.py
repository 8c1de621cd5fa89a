"""Statistics of samples, volumes and prediction maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.volume import ZYX
from lamina.session import cut


def summary(samples: DataFrame) -> DataFrame:
    """Number, sum, nearest-rank percentiles and maximum of each metric."""
    return samples.groupBy("metric").agg(F.count("*").alias("n"), F.sum("ns").alias("total"), *(F.expr(f"percentile_disc({p}) within group (order by ns)").cast("long").alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)), F.max("ns").alias("max"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Element n div 2 of the sorted values of each key."""
    return ranked(df, [key], value, "n div 2").select(key, value)


def tail(df: DataFrame, key: str, value: str, low: bool = False) -> DataFrame:
    """Element n - 1 - n div 20 of the sorted values of each key, or n div 20."""
    return ranked(df, [key], value, "n div 20" if low else "n - 1 - n div 20").select(key, value)


def ranked(df: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """Element ``rank`` (from 0; SQL of ``n``, the number of values) of the sorted values of each key; nulls don't count.

    The values' histogram is dealt by ranges, so that only one range of each key is ranked, not all its values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(counts.repartitionByRange(ranges, *keys, value).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy(*keys)
    sums = counts.groupBy(*keys, "part").agg(F.sum("_k").alias("own"))
    sums = sums.select(*keys, "part", "own", (F.sum("own").over(w.orderBy("part")) - F.col("own")).alias("below"), F.sum("own").over(w).alias("n"))
    at = sums.withColumn("rank", F.expr(rank)).where("rank >= below and rank < below + own").select(*keys, "part", "below", "rank")
    near = counts.join(at, [*keys, "part"]).withColumn("upto", F.col("below") + F.sum("_k").over(w.orderBy(value)))
    return near.where("upto > rank").groupBy(*keys).agg(F.min(value).alias(value))


def last_samples(samples: DataFrame, n: int) -> DataFrame:
    """The last ``n`` samples of each metric."""
    w = Window.partitionBy("metric").orderBy(F.desc("idx"))
    return samples.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of voxels in either, sums of the absolute and the squared difference, and the largest one; absent reads 0."""
    both = a.select(*ZYX, F.col("v").alias("a")).join(b.select(*ZYX, F.col("v").alias("b")), list(ZYX), "full")
    e = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return both.agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("sad"), F.sum((e * e).cast("long")).alias("ssd"), F.max(F.abs(e)).alias("worst"))


def psnr(ssd: Column, n: Column) -> Column:
    """Peak signal to noise ratio in dB for 8-bit values; null where nothing differs."""
    return F.when(ssd > 0, 10 * F.log10(255.0 * 255.0 * n / ssd))


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised cross-correlation over voxels that both have."""
    both = a.select(*ZYX, F.col("v").alias("a")).join(b.select(*ZYX, F.col("v").alias("b")), list(ZYX))
    return both.agg(F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("ncc"), F.count("*").alias("n"))


def rescaled(p: Column) -> Column:
    """A probability stretched from 0.25..0.75 to 0..1."""
    return F.least(F.greatest((p - 0.25) * 2, F.lit(0.0)), F.lit(1.0))


def ramp(k: Column, n: int) -> Column:
    """Weight of a tile's cell for blending: cells from the nearest edge, 1 at it."""
    return F.least(k + 1, n - k).cast("double")


def blended(tiles: DataFrame, n: int) -> DataFrame:
    """Overlapping n by n tiles (ty, tx: first cell; py, px; p) as one map: sum of p w over sum of w."""
    w = ramp(F.col("py"), n) * ramp(F.col("px"), n)
    return tiles.groupBy((F.col("ty") + F.col("py")).alias("y"), (F.col("tx") + F.col("px")).alias("x")).agg((F.sum(F.col("p") * w) / F.sum(w)).alias("p"))


def merged_variants(variants: DataFrame, n: int) -> DataFrame:
    """Mean of test-time variants (map, variant, py, px, p) of n by n maps, each turned back first: variant 1 is mirrored in x, 2 in y, 3 in both."""
    y = F.when(F.col("variant") >= 2, n - 1 - F.col("py")).otherwise(F.col("py")).cast("int").alias("py")
    x = F.when(F.col("variant") % 2 == 1, n - 1 - F.col("px")).otherwise(F.col("px")).cast("int").alias("px")
    return variants.select("map", y, x, "p").groupBy("map", "py", "px").agg(F.avg("p").alias("p"))


def quality_ladder(um: Column, level: Column) -> tuple[Column, Column]:
    """Quality and tolerance of a level: from the voxel size, halved for each level, 1 at least; the tolerance is twice that."""
    first = F.when(um <= 1.5, 64.0).when(um <= 3.2, 32.0).when(um <= 6.0, 16.0).when(um <= 20.0, 8.0).otherwise(2.0)
    q = F.greatest(first / F.pow(F.lit(2.0), level), F.lit(1.0))
    return q, 2 * q


def voxel_size(path: Column) -> Column:
    """The first number before "um" in a path that lies between 0.05 and 1000; 0 if there is none."""
    every = F.transform(F.regexp_extract_all(path, F.lit(r"([0-9.]+)um"), F.lit(1)), lambda s: s.try_cast("double"))
    good = F.filter(every, lambda x: (x > 0.05) & (x < 1000))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(0.0))


def physical_area(voxels: Column, um: Column) -> Column:
    """An area in square voxels as text, in the unit that fits."""
    a = voxels * um * um
    return F.when(um <= 0, F.format_string("%.0f vx2", voxels)).when(a >= 1e8, F.format_string("%.2f cm2", a / 1e8)).when(a >= 1e6, F.format_string("%.2f mm2", a / 1e6)).otherwise(F.format_string("%.0f um2", a))


def safe_name(name: Column) -> Column:
    """Whether a listed name may be used as a file name."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9._][A-Za-z0-9._-]*$") & ~name.isin(".", ".."), F.lit(False))
