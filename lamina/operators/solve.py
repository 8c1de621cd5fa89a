"""Solvers: surface growth and tracing, potentials, flattening, registration, fitted surfaces, donors.

What is data stays in Spark: neighbourhoods, samples and normal equations are joins and
aggregations. Numpy solves what is small by nature, a cell's own few unknowns (many cells at once)
or one segment's grid, and the driver solves systems of a dozen unknowns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import sampling
from lamina.operators.axis import wrapped
from lamina.operators.flatten import along
from lamina.operators.surface import CELL, XYZ
from lamina.session import cut

FIVE = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a or b]


def fringe(cells: DataFrame, height: int, width: int, least: int = 3) -> DataFrame:
    """Empty cells with at least ``least`` set ones in their 5 by 5: ``near`` holds their offsets and positions."""
    o = F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in FIVE))
    sent = cells.select(*CELL, *XYZ, F.explode(o).alias("o"))
    sent = sent.select("seg_id", (F.col("j") - F.col("o.dj")).alias("j"), (F.col("i") - F.col("o.di")).alias("i"), F.struct(F.col("o.dj").alias("dj"), F.col("o.di").alias("di"), *XYZ).alias("p"))
    sent = sent.where((F.col("j") >= 0) & (F.col("i") >= 0) & (F.col("j") < height) & (F.col("i") < width))
    near = sent.groupBy(*CELL).agg(F.array_sort(F.collect_list("p")).alias("near")).where(F.size("near") >= least)
    return near.join(cells.select(*CELL), list(CELL), "left_anti")


def predicted(near: DataFrame) -> DataFrame:
    """Position of each fringe cell by an affine fit to its neighbours, weighted by nearness on the grid; cells whose neighbours lie on a line are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["near"].str.len().to_numpy(int)
            flat = np.array([(p["dj"], p["di"], p["x"], p["y"], p["z"]) for near in b["near"] for p in near], float).reshape(-1, 5)
            if not len(flat):
                continue
            first = np.cumsum(size) - size
            a = np.column_stack((np.ones(len(flat)), flat[:, :2]))
            w = np.exp(-0.5 * (flat[:, :2] ** 2).sum(1))[:, None, None]
            m = np.add.reduceat(w * a[:, :, None] * a[:, None, :], first)  # a 3 by 3 system a cell, all solved at once
            r = np.add.reduceat(w * a[:, :, None] * flat[:, None, 2:], first)
            good = np.linalg.cond(m) < 1e6
            yield pd.DataFrame({c: b[c].to_numpy()[good] for c in CELL} | dict(zip(XYZ, np.linalg.solve(m[good], r[good])[:, 0].T, strict=True)))

    return near.mapInPandas(run, "seg_id int, j int, i int, x double, y double, z double")


def snapped(candidates: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """Candidates moved to the nearest of ``targets(x, y, z)`` within ``reach``, ties by position; others are dropped."""
    t = targets.select(*(F.floor(F.col(c) / reach).cast("int").alias("c" + c) for c in XYZ), *(F.col(c).cast("double").alias("t" + c) for c in XYZ))
    own = candidates
    for c in XYZ:
        k = F.floor(F.col(c) / reach).cast("int")
        own = own.withColumn("c" + c, F.explode(F.sequence(k - 1, k + 1)))
    d2 = sum(((F.col(c) - F.col("t" + c)) ** 2 for c in XYZ), F.lit(0.0))
    best = own.join(t, ["c" + c for c in XYZ]).select(*CELL, F.struct(d2.alias("d2"), *(F.col("t" + c).alias(c) for c in XYZ)).alias("s")).where(F.col("s.d2") <= reach * reach)
    return best.groupBy(*CELL).agg(F.min("s").alias("s")).select(*CELL, *(F.col("s." + c).alias(c) for c in XYZ))


def grown(seeds: DataFrame, targets: DataFrame, height: int, width: int, generations: int, step: float, reach: float, within: DataFrame | None = None) -> DataFrame:
    """Surface cells ``(seg_id, j, i, x, y, z, gen)`` grown from seeds over boundary points: each generation the whole fringe is predicted, snapped and
    gated (an edge to a set neighbour must be between half and one and a half steps), all from the state before it; only cells of ``within`` are grown, where it is given."""
    now = cut(seeds.select(*CELL, *(F.col(c).cast("double").alias(c) for c in XYZ), F.lit(0).alias("gen")))
    goal = cut(targets.select(*XYZ).distinct())
    for g in range(1, generations + 1):
        edge = fringe(now, height, width)
        new = snapped(predicted(edge if within is None else edge.join(within, list(CELL), "left_semi")), goal, reach)
        o = F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))
        sent = now.select("seg_id", F.col("j").alias("nj"), F.col("i").alias("ni"), *(F.col(c).alias("n" + c) for c in XYZ), F.explode(o).alias("o"))
        sent = sent.select("seg_id", (F.col("nj") + F.col("o.dj")).alias("j"), (F.col("ni") + F.col("o.di")).alias("i"), *("n" + c for c in XYZ))
        gap = F.sqrt(sum(((F.col(c) - F.col("n" + c)) ** 2 for c in XYZ), F.lit(0.0)))
        good = new.join(sent, list(CELL)).groupBy(*CELL).agg(F.min(gap).alias("lo"), F.max(gap).alias("hi")).where((F.col("lo") >= 0.5 * step) & (F.col("hi") <= 1.5 * step))
        new = cut(new.join(good.select(*CELL), list(CELL)).select(*CELL, *XYZ, F.lit(g).alias("gen")))
        if new.isEmpty():
            break
        now = cut(now.union(new))
    return now


def relaxed(cells: DataFrame, distance: DataFrame, step: float, rounds: int, pull: float = 0.5) -> DataFrame:
    """Cells moved by rounds of two colours: each moves along the gradient of ``distance(z, y, x, v)``, a volume of distances to the sheet, by a share
    of its value there, and towards keeping its edges at one step. Cells of one colour share no edge, so they may move at once."""
    now = cells.select(*CELL, *XYZ)
    for k in range(rounds):
        colour = (F.col("i") + F.col("j")) % 2 == k % 2
        moving = now.where(colour)
        pts = moving.select(F.struct(*CELL).alias("pt_id"), *XYZ)
        s = sampling.trilinear(pts, distance).select("pt_id.*", "value", "gx", "gy", "gz")
        o = F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))
        near = now.select("seg_id", F.explode(o).alias("o"), "j", "i", *(F.col(c).alias("n" + c) for c in XYZ)).select("seg_id", (F.col("j") + F.col("o.dj")).alias("j"), (F.col("i") + F.col("o.di")).alias("i"), *("n" + c for c in XYZ))
        d = [F.col(c) - F.col("n" + c) for c in XYZ]
        size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        wish = moving.join(near, list(CELL)).where(size > 1e-9).groupBy(*CELL).agg(*(F.avg(F.col("n" + c) + e * step / size - F.col(c)).alias("w" + c) for c, e in zip(XYZ, d, strict=True)))
        g2 = F.greatest(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2, F.lit(1e-3))
        moved = moving.join(s, list(CELL)).join(wish, list(CELL), "left")
        moved = moved.select(*CELL, *((F.col(c) - pull * F.col("value") * F.col("g" + c) / g2 + 0.5 * F.coalesce("w" + c, F.lit(0.0))).alias(c) for c in XYZ))
        now = cut(now.where(~colour).union(moved))
    return now


def winding_potential(cells: DataFrame, rounds: int = 200, tol: float = 1e-10) -> DataFrame:
    """``wind`` of each cell (seg_id, j, i, theta) so that neighbours differ by their turn as nearly as can be; the first cell of a segment has 0.

    Conjugate gradients on all segments at once: the matrix product sends each cell's value to its
    linked neighbours and sums by cell, inner products are sums by segment, which reach the cells without bringing a segment together. Links that turn over a
    quarter are cut. It ends when every segment's residual is under ``tol``, or after ``rounds``.
    """
    o = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    near = F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in o))
    sent = cells.select("seg_id", "j", "i", F.col("theta").alias("t"), F.explode(near).alias("o"))
    sent = sent.select("seg_id", (F.col("j") + F.col("o.dj")).cast("int").alias("j"), (F.col("i") + F.col("o.di")).cast("int").alias("i"), "t", F.struct((-F.col("o.dj")).alias("dj"), (-F.col("o.di")).alias("di")).alias("o"))
    turn = wrapped(F.col("theta") - F.col("t")) / (2 * np.pi)
    linked = sent.join(cells.select(*CELL, "theta"), list(CELL)).where(F.abs(turn) <= 0.25)
    linked = linked.groupBy(*CELL).agg(F.collect_list("o").alias("o"), F.sum(turn).alias("b"))  # four neighbours at most
    none = F.array().cast(linked.schema["o"].dataType)
    now = cells.select(*CELL).join(linked, list(CELL), "left").select(*CELL, F.coalesce("o", none).alias("o"), F.lit(0.0).alias("x"), F.coalesce("b", F.lit(0.0)).alias("r"), F.coalesce("b", F.lit(0.0)).alias("p"))
    by = lambda df, e, name: df.groupBy("seg_id").agg(F.sum(e).alias(name))
    segments = cells.select("seg_id").distinct().count()
    now = cut(along(now, by(now, F.col("r") * F.col("r"), "rr"), segments))
    for _ in range(rounds):
        if not now.where(F.col("rr") > tol).take(1):
            break
        moved = now.select("seg_id", "j", "i", "p", F.explode("o").alias("n")).select("seg_id", (F.col("j") + F.col("n.dj")).cast("int").alias("j"), (F.col("i") + F.col("n.di")).cast("int").alias("i"), "p")
        sums = moved.groupBy(*CELL).agg(F.sum("p").alias("near"))
        q = F.size("o") * F.col("p") - F.coalesce("near", F.lit(0.0)) + 1e-9 * F.col("p")
        with_q = cut(now.join(sums, list(CELL), "left").select(*CELL, "o", "x", "r", "p", "rr", q.alias("q")))
        step = with_q.groupBy("seg_id").agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.first("rr").alias("was"))
        step = step.select("seg_id", F.when((F.col("was") > tol) & (F.col("pq") > 0), F.col("was") / F.col("pq")).otherwise(0.0).alias("a"))
        after = along(with_q, step, segments).select(*CELL, "o", (F.col("x") + F.col("a") * F.col("p")).alias("x"), (F.col("r") - F.col("a") * F.col("q")).alias("r"), "p", "rr")
        new = by(after, F.col("r") * F.col("r"), "new")
        now = cut(along(after, new, segments).select(*CELL, "o", "x", "r", (F.col("r") + F.when(F.col("rr") > 0, F.col("new") / F.col("rr")).otherwise(0.0) * F.col("p")).alias("p"), F.col("new").alias("rr")))
    first = now.groupBy("seg_id").agg(F.min_by("x", F.struct("j", "i")).alias("x0"))
    return along(now, first, segments).select(*CELL, (F.col("x") - F.col("x0")).alias("wind"))


def registered(fixed: DataFrame, moving: DataFrame, start: Sequence[Sequence[float]], rounds: int = 10, damping: float = 1e-3) -> list[list[float]]:
    """The affine map fixed to moving of least squared difference, by Gauss-Newton: each round is one aggregation of 90 sums over the fixed voxels."""
    m = np.array(start, float)
    for _ in range(rounds):
        pts = fixed.select(F.struct("z", "y", "x").alias("pt_id"), *(a.alias(c) for a, c in zip(sampling.affine(m.tolist()), XYZ, strict=True)), F.col("v").alias("f"), *(F.col(c).cast("double").alias("f" + c) for c in XYZ))
        s = sampling.trilinear(pts.select("pt_id", *XYZ), moving).join(pts.select("pt_id", "f", *("f" + c for c in XYZ)), "pt_id")
        rows = [F.col("g" + g) * h for g in XYZ for h in (*(F.col("f" + c) for c in XYZ), F.lit(1.0))]
        r = F.col("f") - F.col("value")
        n = len(rows)
        sums = s.agg(*(F.sum(rows[i] * rows[j]) for i in range(n) for j in range(i, n)), *(F.sum(e * r) for e in rows)).first()
        a = np.zeros((n, n))
        a[np.triu_indices(n)] = [float(v or 0) for v in sums[: n * (n + 1) // 2]]
        a = a + np.triu(a, 1).T
        d = np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-9)), [float(v or 0) for v in sums[n * (n + 1) // 2 :]])
        m += d.reshape(3, 4)
        if np.abs(d).max() < 1e-4:
            break
    return m.tolist()


def principal_frame(points: DataFrame) -> tuple[list[float], list[list[float]]]:
    """The mean of ``points(x, y, z)`` and their three principal axes, the widest first: ten sums over the points, solved by the driver."""
    pair = [(a, b) for k, a in enumerate(XYZ) for b in XYZ[k:]]
    s = points.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in XYZ), *(F.covar_pop(a, b).alias(a + b) for a, b in pair)).first()
    m = np.array([[s["".join(sorted((a, b)))] or 0.0 for b in XYZ] for a in XYZ])
    return [s[c] or 0.0 for c in XYZ], np.linalg.eigh(m)[1].T[::-1].tolist()


#: Fixed values of surfaces through picked points: nodes a side at most, kernel width in steps and in mean distances of points, its reach in widths, the weight a node must have.
NODES, KERNEL_STEPS, KERNEL_GAPS, KERNEL_REACH, LEAST_WEIGHT = 1024, 3.0, 1.5, 3.0, 0.35


def picked_surface(points: DataFrame, origin: Sequence[float], axes: Sequence[Sequence[float]], step: float) -> DataFrame:
    """Grid points (j, i, x, y, z) of a surface through unordered ``points(x, y, z)``, over the plane of the first two axes (see ``principal_frame``).

    At each node a plane is fit to the points within the kernel's reach, with Gaussian weights (moving
    least squares): every point is sent to the nodes it reaches and nine sums a node are combined before
    the shuffle; the three unknowns are solved in closed form, and where the points lie on a line their
    weighted mean counts. Nodes with less than ``LEAST_WEIGHT`` aren't in it. The step is halved up to
    three times where there would be under 128 nodes or under 100 of them on the surface; under 16, or
    points that lie on a line, give none.
    """
    local = cut(points.select(*(sum(((F.col(c) - o) * a for c, o, a in zip(XYZ, origin, axis, strict=True)), F.lit(0.0)).alias(n) for n, axis in zip("uvw", axes, strict=True))))
    b = local.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in "uv" for k, f in enumerate((F.min, F.max)))).first()
    none = points.sparkSession.createDataFrame([], "j int, i int, x double, y double, z double")
    if not b["n"] or b["u1"] - b["u0"] < 2 or b["v1"] - b["v0"] < 2:
        return none
    wide, high = b["u1"] - b["u0"], b["v1"] - b["v0"]
    for halved in range(4):
        size = step / 2**halved
        w, h = (min(NODES, max(2, int(x / size) + 2)) for x in (wide, high))
        if w * h < 128 and halved < 3:
            continue
        kernel = max(KERNEL_STEPS * size, KERNEL_GAPS * max(1.0, wide * high / b["n"]) ** 0.5)
        reach, du, dv = KERNEL_REACH * kernel, wide / (w - 1), high / (h - 1)
        near = lambda c, lo, d, n: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - reach - lo) / d) - 1), F.least(F.lit(n - 1), F.floor((F.col(c) + reach - lo) / d) + 1)))  # noqa: E731, B023
        sent = local.withColumn("i", near("u", b["u0"], du, w)).withColumn("j", near("v", b["v0"], dv, h))
        sent = sent.select(F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"), (F.col("u") - (b["u0"] + wide * F.col("i") / (w - 1))).alias("p"), (F.col("v") - (b["v0"] + high * F.col("j") / (h - 1))).alias("q"), "w")
        d2 = F.col("p") * F.col("p") + F.col("q") * F.col("q")
        sent = sent.where(d2 <= reach * reach).withColumn("k", F.exp(-d2 / (2 * kernel * kernel)))
        sums = {"a": "k", "p": "k * p", "q": "k * q", "pp": "k * p * p", "pq": "k * p * q", "qq": "k * q * q", "b0": "k * w", "b1": "k * p * w", "b2": "k * q * w"}
        node = sent.groupBy("j", "i").agg(*(F.sum(F.expr(e)).alias(n) for n, e in sums.items())).where(F.col("a") >= LEAST_WEIGHT)
        det = F.expr("a * (pp * qq - pq * pq) - p * (p * qq - pq * q) + q * (p * pq - pp * q)")
        fit = F.expr("b0 * (pp * qq - pq * pq) - p * (b1 * qq - pq * b2) + q * (b1 * pq - pp * b2)") / det
        node = cut(node.select("j", "i", F.when(F.abs(det) > 1e-9 * (F.col("a") + 1), fit).otherwise(F.col("b0") / F.col("a")).alias("w")))
        many = node.count()
        if many >= 100 or halved == 3:
            break
    if many < 16:
        return none
    at = [b["u0"] + wide * F.col("i") / (w - 1), b["v0"] + high * F.col("j") / (h - 1), F.col("w")]
    return node.select("j", "i", *(sum((t * axis[k] for t, axis in zip(at, axes, strict=True)), F.lit(float(o))).alias(c) for k, (c, o) in enumerate(zip(XYZ, origin, strict=True))))


def lattice_resampled(uv: DataFrame, step: float = 1.0) -> DataFrame:
    """Surface positions at lattice points (lv, lu) of an embedding (seg_id, j, i, u, v, x, y, z); where triangles overlap the last in scan order counts."""
    from lamina.operators.surface import around

    q = around(uv, {"p00": (0, 0), "p10": (0, 1), "p01": (1, 0), "p11": (1, 1)}, ("u", "v"))
    tri = F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))) for k, (a, b, c) in enumerate((("p00", "p10", "p01"), ("p10", "p11", "p01")))))
    t = q.select(*CELL, F.explode(tri).alias("t")).where("t is not null").select(*CELL, "t.*")
    for c in "uv":
        corner = [F.col(f"{p}.{c}") / step for p in "abc"]
        t = t.withColumn("l" + c, F.explode(F.sequence(F.ceil(F.least(*corner)), F.floor(F.greatest(*corner)))))  # an empty range gives a descending one, which the test below refuses
    ax, ay, bx, by, cx, cy = (F.col(f"{p}.{c}") for p in "abc" for c in "uv")
    px, py = F.col("lu") * step, F.col("lv") * step
    det = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    w1 = ((px - ax) * (cy - ay) - (cx - ax) * (py - ay)) / det
    w2 = ((bx - ax) * (py - ay) - (px - ax) * (by - ay)) / det
    t = t.withColumns({"w1": w1, "w2": w2}).where((F.abs(det) > 1e-12) & (F.col("w1") >= 0) & (F.col("w2") >= 0) & (F.col("w1") + F.col("w2") <= 1))
    pos = [(F.col(f"a.{c}") + F.col("w1") * (F.col(f"b.{c}") - F.col(f"a.{c}")) + F.col("w2") * (F.col(f"c.{c}") - F.col(f"a.{c}"))).alias(c) for c in XYZ]
    best = t.select("seg_id", "lv", "lu", F.struct("j", "i", "k", *pos).alias("s")).groupBy("seg_id", "lv", "lu").agg(F.max("s").alias("s"))
    return best.select("seg_id", "lv", "lu", *(F.col("s." + c).alias(c) for c in XYZ))


def donor_agreement(distances: DataFrame, cells: int) -> DataFrame:
    """Mean, root mean square and 95th percentile (element n - 1 - n div 20) of distances ``(pt_id, d2)`` to donors, and the share of the cells that have one."""
    from lamina.operators.stats import ranked

    distances = cut(distances.select("d2"))
    s = distances.agg(F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("mean"), F.sqrt(F.avg("d2")).alias("rms"))
    p95 = ranked(distances, [], "d2", "n - 1 - n div 20").select(F.sqrt("d2").alias("p95"))
    share = F.col("n") / cells if cells else F.lit(None).cast("double")
    return s.crossJoin(p95).select("n", "mean", "rms", "p95", share.alias("coverage"))


def donor_offsets(matches: DataFrame) -> DataFrame:
    """Winding offset of each donor: the upper median of cell minus donor winding over ``(donor_id, cell_wind, donor_wind)``, and the number of matches within 0.3 of it."""
    from lamina.operators.stats import upper_median

    m = matches.select("donor_id", (F.col("cell_wind") - F.col("donor_wind")).alias("d"))
    mid = upper_median(m, "donor_id", "d").withColumnRenamed("d", "offset")
    return m.join(mid, "donor_id").groupBy("donor_id", "offset").agg(F.count_if(F.abs(F.col("d") - F.col("offset")) <= 0.3).alias("members"))


def shifted(cells: DataFrame, dj: int, di: int) -> DataFrame:
    """The cells on a larger grid whose first row and column lie ``dj`` and ``di`` before."""
    return cells.withColumns({"j": (F.col("j") + dj).cast("int"), "i": (F.col("i") + di).cast("int")})


#: Fixed values of suspects: confidence under which, and error of winding over which a cell is one; the core about a correction.
LEAST_CONFIDENCE, MOST_ERROR, CORE = 0.5, 0.3, 2


def reopened(cells: DataFrame, corrections: DataFrame, height: int, width: int, radius: int = 8, reach: float = 100.0) -> DataFrame:
    """Cells (seg_id, j, i) about ``corrections(pt_id, x, y, z)`` that are to be grown anew, of ``cells`` with ``conf`` and ``werr``.

    About the cell nearest to a correction (within ``reach``; ties by key) the flood takes the cells that
    are within ``CORE`` or suspect, and connected with it over such cells within ``radius``. A correction
    whose flood comes next to the rim of the grid opens nothing. Floods are components of the cells that
    each correction allows, at most (2 radius + 1)**2 of them.
    """
    from lamina.operators.graph import least_of_component
    from lamina.operators.index import nearest

    radius, side = max(3, radius), 2 * max(3, radius) + 1
    at = nearest(corrections, cells, reach, step=1).select("seg_id", F.col("j").alias("cj"), F.col("i").alias("ci")).distinct()
    at = cut(at.withColumn("k", F.monotonically_increasing_id()))
    box = at.withColumn("dj", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("di", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    box = box.select("k", "seg_id", (F.col("cj") + F.col("dj")).alias("j"), (F.col("ci") + F.col("di")).alias("i"), "dj", "di")
    core = F.greatest(F.abs("dj"), F.abs("di")) <= CORE
    open_ = box.join(cells.select(*CELL, "conf", "werr"), list(CELL)).where(core | (F.col("conf") < LEAST_CONFIDENCE) | (F.col("werr") > MOST_ERROR))
    node = lambda dj, di: F.col("k") * (side * side) + (F.col("dj") + dj + radius) * side + F.col("di") + di + radius
    open_ = cut(open_.select("k", *CELL, node(0, 0).alias("u"), ((F.col("dj") == 0) & (F.col("di") == 0)).alias("centre"), F.array(F.when(F.col("di") < radius, node(0, 1)), F.when(F.col("dj") < radius, node(1, 0))).alias("next")))
    links = open_.select(F.col("u").alias("v"), F.explode("next").alias("n")).where("n is not null").join(open_.select(F.col("u").alias("n")), "n").select(F.col("n").alias("u"), "v")
    label = least_of_component(links).withColumnRenamed("v", "c")
    named = cut(open_.join(label, "u", "left").select("k", *CELL, "centre", F.coalesce("c", "u").alias("c")))
    flood = cut(named.join(named.where("centre").select("c"), "c", "left_semi"))
    rim = flood.where((F.col("i") <= 1) | (F.col("j") <= 1) | (F.col("i") >= width - 2) | (F.col("j") >= height - 2)).select("k").distinct()
    return flood.join(rim, "k", "left_anti").select(*CELL).distinct()


def reoptimised(cells: DataFrame, corrections: DataFrame, targets: DataFrame, height: int, width: int, step: float, snap: float, radius: int = 8, reach: float = 100.0) -> DataFrame:
    """Cells (seg_id, j, i, x, y, z, gen) with the regions about the corrections emptied and grown again within themselves, over at most ``radius + 5`` generations; all others as they were, with ``gen`` 0."""
    region = cut(reopened(cells, corrections, height, width, radius, reach))
    return grown(cells.join(region, list(CELL), "left_anti"), targets, height, width, radius + 5, step, snap, region)


def regrown(cells: DataFrame, suspects: DataFrame, targets: DataFrame, height: int, width: int, generations: int, step: float, reach: float) -> DataFrame:
    """Surface with the suspect cells, and set ones that touch them, emptied and grown again from the rest."""
    o = F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    wide = suspects.select(*CELL, F.explode(o).alias("o")).select("seg_id", (F.col("j") + F.col("o.dj")).alias("j"), (F.col("i") + F.col("o.di")).alias("i")).distinct()
    return grown(cells.join(wide, list(CELL), "left_anti"), targets, height, width, generations, step, reach)


def populated(grid: DataFrame, fit: dict, axis: tuple[float, float], depth: float) -> DataFrame:
    """Positions of cells ``(seg_id, j, i, theta, wind, z)`` from a spiral fit (see ``axis.spiral_fit``) about a straight axis."""
    knots = len(fit["r0"])
    step = depth / (knots - 1)
    rho = sum((float(r) * F.greatest(F.lit(0.0), 1 - F.abs(F.col("z") / step - k)) for k, r in enumerate(fit["r0"])), F.lit(0.0))
    a, b, c, d = fit["harmonics"]
    rho = rho + a * F.cos("theta") + b * F.sin("theta") + c * F.cos(2 * F.col("theta")) + d * F.sin(2 * F.col("theta")) + fit["omega"] * F.col("wind")
    return grid.select(*CELL, (axis[0] + rho * F.cos("theta")).alias("x"), (axis[1] + rho * F.sin("theta")).alias("y"), F.col("z").cast("double").alias("z"))


def paths_near(lines: DataFrame, x: float, y: float, radius: float, bucket: float = 64.0) -> DataFrame:
    """Distinct paths of ``lines(path_id, x0, y0, x1, y1)`` in the buckets within a radius of a point, which become a range of bucket keys."""
    b = lines.select("path_id", F.explode(F.sequence(F.floor(F.least("x0", "x1") / bucket), F.floor(F.greatest("x0", "x1") / bucket))).alias("bx"), "y0", "y1").select("path_id", "bx", F.explode(F.sequence(F.floor(F.least("y0", "y1") / bucket), F.floor(F.greatest("y0", "y1") / bucket))).alias("by"))
    near = lambda c, p: F.col(c).between(int((p - radius) // bucket), int((p + radius) // bucket))
    return b.where(near("bx", x) & near("by", y)).select("path_id").distinct()
