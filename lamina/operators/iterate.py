"""Operators that repeat a step until nothing changes, or a given number of times.

Each round is a snapshot: it reads the state of the round before (Jacobi), never one half changed.
Lineage is cut in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.graph import least_of_component
from lamina.operators.surface import CELL, XYZ
from lamina.session import cut

FOUR = [(0, 1), (0, -1), (1, 0), (-1, 0)]


def _near(cells: DataFrame) -> DataFrame:
    """Each cell once for each of its 4 neighbours, at the neighbour's place; other columns go along."""
    o = F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in FOUR))
    rest = [c for c in cells.columns if c not in CELL]
    s = cells.select(*CELL, *rest, F.explode(o).alias("o"))
    return s.select("seg_id", (F.col("j") + F.col("o.dj")).cast("int").alias("j"), (F.col("i") + F.col("o.di")).cast("int").alias("i"), *rest)


def grid_of(spark, sizes: DataFrame) -> DataFrame:
    """All cells of segments of ``sizes(seg_id, h, w)``."""
    return sizes.select("seg_id", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("j")).select("seg_id", "j", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("i"))


def holes(filled: DataFrame, sizes: DataFrame) -> DataFrame:
    """Empty cells that no path over empty cells connects with the grid's border."""
    cell = F.col("j").cast("long") * F.lit(1 << 24) + F.col("i")
    empty = grid_of(filled.sparkSession, sizes).join(filled.select(*CELL), list(CELL), "left_anti").join(sizes.select("seg_id", "h", "w"), "seg_id")
    names = sizes.select("seg_id", F.xxhash64("seg_id").alias("s"))
    empty = cut(empty.join(names, "seg_id").select(*CELL, F.xxhash64("s", cell).alias("n"), ((F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == F.col("w") - 1) | (F.col("j") == F.col("h") - 1)).alias("rim")))
    near = empty.join(_near(empty.select(*CELL, F.col("n").alias("m"))), list(CELL)).where("n > m").select(F.col("n").alias("u"), F.col("m").alias("v"))
    part = cut(empty.join(least_of_component(near).withColumnRenamed("u", "n"), "n", "left").select(*CELL, "rim", F.coalesce("v", "n").alias("c")))
    return part.join(cut(part.where("rim").select("c").distinct()), "c", "left_anti").select(*CELL)


def membrane(known: DataFrame, missing: DataFrame, value: str, rounds: int) -> DataFrame:
    """Values for the missing cells: each round the mean of the neighbours that have one; known cells keep theirs."""
    now = known.select(*CELL, F.col(value).cast("double").alias("f"))
    fixed = now
    for k in range(rounds):
        m = _near(now).groupBy(*CELL).agg(F.avg("f").alias("f"))
        now = fixed.union(missing.select(*CELL).join(m, list(CELL)).select(*CELL, "f"))
        if k % 3 == 2:
            now = cut(now)
    return now.join(missing.select(*CELL), list(CELL), "left_semi").select(*CELL, F.col("f").alias(value))


def rewound(cells: DataFrame, gen: int) -> DataFrame:
    """Cells set in a generation up to ``gen``; later ones, and failed or pending ones, become empty, that is absent."""
    return cells.where((F.col("state") == 1) & (F.col("gen") <= gen))


def confidence(distance: Column, donors: Column, reach: float = 12.0) -> Column:
    """1 less the distance over its reach, with floors of 0.75 and 0.95 for one and for more donors."""
    own = 1 - F.least(distance, F.lit(reach)) / reach
    return F.greatest(own, F.when(donors >= 2, 0.95).when(donors == 1, 0.75).otherwise(0.0))


def filled_gaps(gaps: DataFrame, passes: int, shape: Sequence[int]) -> DataFrame:
    """``cell(z, y, x, g)`` with empty cells of a 3-D grid of that shape filled pass by pass with the mean of their 6 neighbours."""
    from lamina.operators.stencil import FACES, spread
    from lamina.operators.volume import ZYX

    now = gaps.select(*ZYX, F.col("g").cast("double").alias("g"))
    for _ in range(passes):
        m = spread(now, FACES).groupBy(*ZYX).agg(F.avg("g").alias("g"))
        inside = " and ".join(f"{c} >= 0 and {c} < {n}" for c, n in zip(ZYX, shape, strict=True))
        now = cut(now.union(m.join(now, list(ZYX), "left_anti").where(inside)))
    return now


def energy(sp: DataFrame, step: float) -> DataFrame:
    """Residual terms of each cell as numbers: distance to the right and lower neighbour from the step, straightness along both axes, and planarity of the quad."""
    from lamina.operators.surface import around, cross, dot, length, sub

    o = {"p": (0, 0), "r": (0, 1), "l": (0, -1), "d": (1, 0), "u": (-1, 0), "q": (1, 1)}
    n = around(sp, o).where("p is not null")
    straight = lambda a, b: dot(*[[F.col(f"{a}.{c}") + F.col(f"{b}.{c}") - 2 * F.col(f"p.{c}") for c in XYZ]] * 2)
    m = cross(sub("r", "p"), sub("d", "p"))
    return n.select(
        *CELL,
        (length(sub("r", "p")) - step).alias("dist_i"),
        (length(sub("d", "p")) - step).alias("dist_j"),
        straight("r", "l").alias("straight_i"),
        straight("d", "u").alias("straight_j"),
        (dot(m, sub("q", "p")) / length(m)).alias("planar"),
    )


def symmetric_dirichlet(sp: DataFrame, step: float) -> DataFrame:
    """Distortion of each quad's frame against a flat step: s0**2 + s1**2 + s0**-2 + s1**-2, 4 where there is none."""
    from lamina.operators.surface import cross, dot, quads, sub

    a, b = sub("p10", "p00"), sub("p01", "p00")
    e, g = dot(a, a) / step**2, dot(b, b) / step**2
    n = cross(a, b)
    det2 = dot(n, n) / step**4
    return quads(sp).where(det2 > 1e-12).select(*CELL, (e + g + (e + g) / det2).alias("energy"))


def edge_snap(rays: DataFrame) -> DataFrame:
    """Of samples ``(seg_id, j, i, step, v)`` along a cell's normal, in whole steps, the step with the steepest rise to the next one; ties go to the nearest, then the lower."""
    nxt = rays.select(*CELL, (F.col("step") - 1).alias("step"), F.col("v").alias("n"))
    r = rays.join(nxt, [*CELL, "step"]).select(*CELL, F.struct((F.col("v") - F.col("n")).alias("fall"), F.abs("step").alias("far"), "step").alias("s"))
    return r.groupBy(*CELL).agg(F.min("s").alias("s")).where("s.fall < 0").select(*CELL, F.col("s.step").alias("step"), (-F.col("s.fall")).alias("rise"))


def first_minimum(rays: DataFrame) -> DataFrame:
    """Of samples (seg_id, j, i, step, v) the first step that isn't above the one before and is under the one after."""
    before = rays.select(*CELL, (F.col("step") + 1).alias("step"), F.col("v").alias("b"))
    after = rays.select(*CELL, (F.col("step") - 1).alias("step"), F.col("v").alias("a"))
    r = rays.join(before, [*CELL, "step"]).join(after, [*CELL, "step"]).where("v <= b and v < a")
    return r.groupBy(*CELL).agg(F.min("step").alias("step"))


def merged_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Segments by name: new ones win over old; of new ones with a name in common the first in order stays."""
    first = new.groupBy("name").agg(F.min(F.struct("seq", *[c for c in new.columns if c not in ("name", "seq")])).alias("s")).select("name", "s.*")
    return old.join(first, "name", "left_anti").select(*new.columns).unionByName(first.select(*new.columns))


def excised(cells: DataFrame, bends: DataFrame, passes: int = 16) -> DataFrame:
    """Cells (seg_id, j, i, x, y, z, gen) without folds: each pass drops, at every fold, the cell of the newest generation among it and its two neighbours on that axis.

    ``bends`` computes turns of a cell frame, as ``surface.bends``.
    """
    now = cells
    for _ in range(passes):
        folds = cut(bends(now).where("cos < 0").select(*CELL, "axis"))
        if folds.isEmpty():
            break
        arm = folds.select("seg_id", F.col("j").alias("fj"), F.col("i").alias("fi"), "axis", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("k"))
        arm = arm.select("seg_id", "fj", "fi", "axis", (F.col("fj") + F.when(F.col("axis") == 1, F.col("k")).otherwise(0)).alias("j"), (F.col("fi") + F.when(F.col("axis") == 0, F.col("k")).otherwise(0)).alias("i"))
        newest = arm.join(now.select(*CELL, "gen"), list(CELL)).groupBy("seg_id", "fj", "fi", "axis").agg(F.max(F.struct("gen", "j", "i")).alias("v"))
        now = cut(now.join(newest.select("seg_id", F.col("v.j").alias("j"), F.col("v.i").alias("i")).distinct(), list(CELL), "left_anti"))
    return now
