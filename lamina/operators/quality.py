"""Quality of surface grids: one row a segment, candidates in order of support, fits that are distrusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import surface as su
from lamina.operators.iterate import grid_of, holes
from lamina.operators.stats import ranked
from lamina.session import cut

#: A fit's residual is distrusted over this many root mean squares, or half a winding if that is more.
RMS = 2.5
TRUST = 0.25
#: Cosine of the turn, 30 degrees, over which a bend is a kink.
KINK = 0.86602540378443864676
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def bend_radii(sp: DataFrame, step: float, reach: float = 20.0) -> DataFrame:
    """``radius`` of the bend at each point along each grid axis, over an arc of about twice ``reach``; 1e30 where it is straight."""
    k = max(1, int(reach / step + 0.5))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cos"))))
    return su.bends(sp, k).select("seg_id", F.when(angle > 1e-4, 2.0 * k * step / angle).otherwise(1e30).alias("radius"))


def report(sp: DataFrame, sizes: DataFrame, step: float) -> DataFrame:
    """Of each segment (``sizes``: seg_id, h, w) its area, filled and hole shares of its bounding box, folds, kinks, root mean square twist, 95th percentile
    of slant, and the 5th percentile and median of the bend radius."""
    sp = cut(sp)
    box = sp.groupBy("seg_id").agg(F.count("*").alias("n"), ((F.max("i") - F.min("i") + 1) * (F.max("j") - F.min("j") + 1)).alias("box"))
    hole = holes(sp, sizes).groupBy("seg_id").agg(F.count("*").alias("holes"))
    radii = cut(bend_radii(sp, step))
    out = box.join(hole, "seg_id", "left").join(su.mesh_quality(sp, KINK).drop("fill"), "seg_id", "left").join(su.area(sp).select("seg_id", "area"), "seg_id", "left")
    out = out.join(ranked(su.slant(sp), ["seg_id"], "slant", "n - 1 - n div 20").withColumnRenamed("slant", "slant_p95"), "seg_id", "left")
    for name, at in (("bend_p5", "n div 20"), ("bend_median", "n div 2")):
        out = out.join(ranked(radii, ["seg_id"], "radius", at).withColumnRenamed("radius", name), "seg_id", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("box")
    return out.select("seg_id", F.coalesce("area", F.lit(0.0)).alias("area"), share("n").alias("fill"), share("holes").alias("hole"), "folds", "kinks", F.sqrt(F.coalesce("twist2", F.lit(0.0))).alias("twist"), "slant_p95", "bend_p5", "bend_median")


def candidates(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Empty cells with a set neighbour: ``n8`` and ``n4`` set neighbours, the place in order of support (more of 8 first, then by cell), and in order of the score 4 n4 + n8."""
    o = F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di"), F.lit(int(not (a and b))).alias("four")) for a, b in EIGHT))
    sent = cells.select(*su.CELL, F.explode(o).alias("o"))
    sent = sent.select("seg_id", (F.col("j") + F.col("o.dj")).cast("int").alias("j"), (F.col("i") + F.col("o.di")).cast("int").alias("i"), "o.four")
    near = sent.groupBy(*su.CELL).agg(F.count("*").alias("n8"), F.sum("four").alias("n4")).join(sizes, "seg_id").where("j >= 0 and i >= 0 and j < h and i < w")
    near = near.join(cells.select(*su.CELL), list(su.CELL), "left_anti").withColumns({"cell": F.col("j") * F.col("w") + F.col("i"), "score": 4 * F.col("n4") + F.col("n8")})
    own = Window.partitionBy("seg_id")
    place = lambda *by: F.row_number().over(own.orderBy(*by)).cast("long")
    return near.select(*su.CELL, "n8", "n4", "score", place(8 - F.col("n8"), "cell").alias("by_support"), place(F.desc("score"), "cell").alias("by_score"))


def distrusted(fits: DataFrame, omega: float) -> DataFrame:
    """``conf`` of ``fits(pt_id, conf, residual, donors)`` after a fit of winding height ``omega``: 0.25 at most where the residual is over half a winding and
    over ``RMS`` root mean squares, unless two donors vouch for the cell."""
    rms = fits.agg(F.sqrt(F.avg(F.col("residual") * F.col("residual")))).first()[0] or 0.0
    far = (F.abs("residual") > max(abs(omega) / 2, RMS * rms)) & (F.col("donors") < 2)
    return fits.select("pt_id", F.when(far, F.least(F.lit(TRUST), F.col("conf"))).otherwise(F.col("conf")).alias("conf"))


def stale_maps(maps: DataFrame, sp: DataFrame) -> DataFrame:
    """Stored maps (seg_id, gw, gh, nvalid) whose surface now has another grid or number of valid points, or is gone."""
    now = sp.groupBy("seg_id").agg((F.max("i") + 1).alias("gw"), (F.max("j") + 1).alias("gh"), F.count("*").alias("nvalid"))
    return maps.join(now, ["seg_id", "gw", "gh", "nvalid"], "left_anti")


def nearest_cell(anchors: DataFrame, cells: DataFrame, reach: int = 3) -> DataFrame:
    """The nearest of ``cells`` on the grid to each anchor, at most ``reach`` steps away on either axis; ties by row and column."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    near = anchors.select("seg_id", F.col("j").alias("aj"), F.col("i").alias("ai")).withColumn("dj", F.explode(step)).withColumn("di", F.explode(step))
    near = near.select("seg_id", "aj", "ai", (F.col("aj") + F.col("dj")).cast("int").alias("j"), (F.col("ai") + F.col("di")).cast("int").alias("i"), (F.col("dj") * F.col("dj") + F.col("di") * F.col("di")).cast("int").alias("d2"))
    best = near.join(cells.select(*su.CELL), list(su.CELL)).groupBy("seg_id", "aj", "ai").agg(F.min(F.struct("d2", "j", "i")).alias("s"))
    return best.select("seg_id", "aj", "ai", "s.*")
