"""Folds cut out of grown surfaces, the newer arm of each, as whole arms.

Three ways in which a sheet doubles back are cut, each pass against one snapshot: a turn of over 90
degrees between neighbours; two cells that lie on each other with opposed normals, though the way from
one to the other along the grid is long; and what is no longer connected with a seed once those are
gone, which is the arm that grew over the crease. Anchors never go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.graph import least_of_component
from lamina.operators.surface import CELL, XYZ, around, dot, normals, sub
from lamina.session import cut

#: Least reach of an overlap, its share of the gap or else of the step, opposed normals, the grid way that is compared and how much longer it is on a fold.
LEAST_REACH, GAP_SHARE, STEP_SHARE, OPPOSED, LONG_WAY, DETOUR = 4.0, 0.5, 0.35, -0.3, 200.0, 4.0


def creases(cells: DataFrame) -> DataFrame:
    """Cells to cut at sharp turns: of a cell and its neighbours on an axis, where the sheet turns back, the newest that is no anchor; ties go to the cell, then the one before."""
    n = around(cells, {"p": (0, 0), "a0": (0, -1), "b0": (0, 1), "a1": (-1, 0), "b1": (1, 0)}, ("gen", "anchor")).where("p is not null")

    def victim(k: int, dj: int, di: int) -> Column:
        one, two = sub("p", f"a{k}"), sub(f"b{k}", "p")
        back = F.col(f"a{k}").isNotNull() & F.col(f"b{k}").isNotNull() & (dot(one, one) >= 1e-12) & (dot(two, two) >= 1e-12) & (dot(one, two) < 0)
        at = lambda name, s, order: F.when(~F.col(f"{name}.anchor"), F.struct(F.col(f"{name}.gen").alias("gen"), F.lit(-order).alias("o"), (F.col("j") + s * dj).alias("j"), (F.col("i") + s * di).alias("i")))
        return F.when(back, F.greatest(at("p", 0, 0), at(f"a{k}", -1, 1), at(f"b{k}", 1, 2)))

    found = n.select("seg_id", F.explode(F.array_compact(F.array(victim(0, 0, 1), victim(1, 1, 0)))).alias("v"))
    return found.select("seg_id", F.col("v.j").alias("j"), F.col("v.i").alias("i")).distinct()


def doubled(cells: DataFrame, step: float, gap: Column | None = None) -> DataFrame:
    """Cells to cut where a sheet lies on itself: of two cells nearer than ``reach`` with opposed normals that are far apart along the grid, the newer, then the less sure one.

    ``gap`` is the distance of sheets at a cell where it is known. Pairs meet in hash cells as wide as the largest reach.
    """
    known = F.lit(0.0) if gap is None else F.coalesce(gap, F.lit(0.0))
    reach = F.greatest(F.lit(LEAST_REACH), F.when(known > 0, GAP_SHARE * known).otherwise(STEP_SHARE * step))
    own = cut(cells.withColumn("reach", reach).join(normals(cells.select(*CELL, *XYZ)), list(CELL)))
    width = own.agg(F.max("reach")).first()[0]
    if width is None:
        return cells.select(*CELL).limit(0)
    key = [F.floor(F.col(c) / width).cast("int") for c in XYZ]
    two = own.select("seg_id", *(F.col(c).alias(c + "2") for c in ("j", "i", *XYZ, "nx", "ny", "nz", "gen", "conf", "anchor")), *(k.alias("k" + c) for k, c in zip(key, XYZ, strict=True)))
    one = own
    for k, c in zip(key, XYZ, strict=True):
        one = one.withColumn("k" + c, F.explode(F.sequence(k - 1, k + 1)))
    far = F.greatest(F.abs(F.col("j2") - F.col("j")), F.abs(F.col("i2") - F.col("i")))
    d2 = sum(((F.col(c) - F.col(c + "2")) ** 2 for c in XYZ), F.lit(0.0))
    facing = sum((F.col("n" + c) * F.col(f"n{c}2") for c in XYZ), F.lit(0.0))
    later = (F.col("j2") > F.col("j")) | (F.col("j2") == F.col("j")) & (F.col("i2") > F.col("i"))
    pair = one.join(two, ["seg_id", *("k" + c for c in XYZ)]).where(later & (far >= 2) & (far * step >= 2 * F.col("reach")) & (d2 < F.col("reach") ** 2) & (facing < OPPOSED))
    pair = cut(pair.select(*CELL, "j2", "i2", far.cast("int").alias("n"), F.sqrt(d2).alias("d"), "gen", "gen2", "conf", "conf2", "anchor", "anchor2"))
    near = pair.where(F.col("n") * step <= LONG_WAY)
    on_way = near.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n"))))
    stop = lambda a, b: F.expr(f"cast({a} + (({b} - {a}) * s + if({b} >= {a}, 1, -1) * (n div 2)) div n as int)")
    on_way = on_way.select("seg_id", F.col("j").alias("j1"), F.col("i").alias("i1"), "j2", "i2", "n", "d", "s", stop("j", "j2").alias("j"), stop("i", "i2").alias("i"))
    on_way = on_way.withColumns({"j": F.when(F.col("s") == 0, F.col("j1")).otherwise(F.col("j")), "i": F.when(F.col("s") == 0, F.col("i1")).otherwise(F.col("i"))})
    line = on_way.join(cells.select(*CELL, *XYZ), list(CELL)).groupBy("seg_id", "j1", "i1", "j2", "i2", "n", "d").agg(F.array_sort(F.collect_list(F.struct("s", *XYZ))).alias("w"))  # LONG_WAY / step cells at most
    leg = lambda a, b: F.sqrt(sum(((a[c] - b[c]) ** 2 for c in XYZ), F.lit(0.0)))
    way = F.aggregate(F.zip_with(F.slice("w", 1, F.col("n")), F.slice("w", 2, F.col("n")), leg), F.lit(0.0), lambda a, x: a + x)
    folded = line.where((F.size("w") == F.col("n") + 1) & (way >= DETOUR * F.col("d"))).select("seg_id", F.col("j1").alias("j"), F.col("i1").alias("i"), "j2", "i2")
    sure = near.join(folded, ["seg_id", "j", "i", "j2", "i2"], "left_semi").union(pair.where(F.col("n") * step > LONG_WAY))
    first = F.when(F.col("anchor") & F.col("anchor2"), F.lit(None)).when(F.col("anchor"), False).when(F.col("anchor2"), True).when(F.col("gen") != F.col("gen2"), F.col("gen") > F.col("gen2")).otherwise(F.col("conf") <= F.col("conf2"))
    named = sure.withColumn("first", first).where("first is not null")
    return named.select("seg_id", F.when(F.col("first"), F.col("j")).otherwise(F.col("j2")).alias("j"), F.when(F.col("first"), F.col("i")).otherwise(F.col("i2")).alias("i")).distinct()


def orphans(cells: DataFrame) -> DataFrame:
    """Cells that no way over neighbours connects with a seed (``gen`` at most 1) or an anchor; none in segments without either."""
    number = (F.col("seg_id").cast("long") * (1 << 40) + F.col("j") * (1 << 20) + F.col("i")).alias("u")
    own = cells.select(*CELL, (F.col("anchor") | (F.col("gen") <= 1)).alias("root"), number)
    step = F.explode(F.array(F.struct(F.lit(0).alias("dj"), F.lit(1).alias("di")), F.struct(F.lit(1).alias("dj"), F.lit(0).alias("di"))))
    to = own.select("seg_id", F.col("u").alias("v"), "j", "i", step.alias("o")).select("seg_id", "v", (F.col("j") + F.col("o.dj")).alias("j"), (F.col("i") + F.col("o.di")).alias("i"))
    label = least_of_component(to.join(own.select(*CELL, "u"), list(CELL)).select("u", "v"))
    named = cut(own.join(label.select("u", F.col("v").alias("c")), "u", "left").select(*CELL, "root", F.coalesce("c", "u").alias("c")))
    rooted = named.where("root").select("c").distinct()
    able = named.where("root").select("seg_id").distinct()
    return named.join(rooted, "c", "left_anti").join(able, "seg_id", "left_semi").select(*CELL)


def excised(cells: DataFrame, step: float, gap: Column | None = None, passes: int = 16) -> tuple[DataFrame, DataFrame]:
    """(cells that stay; cells cut and ``why``: crease, doubled or orphan) of ``cells(seg_id, j, i, x, y, z, gen, conf, anchor)``: up to ``passes`` of each kind of cut, and orphans of the segments that lost cells."""
    now, gone = cut(cells), None

    def drop(bad: DataFrame, why: str) -> bool:
        nonlocal now, gone
        bad = cut(bad)
        if bad.isEmpty():
            return False
        said = bad.select(*CELL, F.lit(why).alias("why"))
        now, gone = cut(now.join(bad, list(CELL), "left_anti")), said if gone is None else gone.union(said)
        return True

    for find, why in ((creases, "crease"), (lambda c: doubled(c, step, gap), "doubled")):
        for _ in range(passes):
            if not drop(find(now), why):
                break
    if gone is not None:
        drop(orphans(now.join(cut(gone.select("seg_id").distinct()), "seg_id", "left_semi")), "orphan")
    return now, gone if gone is not None else cells.select(*CELL, F.lit("").alias("why")).limit(0)
