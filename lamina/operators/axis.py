"""The axis of a rolled sheet: centroids, interpolation, smoothing, cylinder coordinates, windings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.surface import CELL
from lamina.session import cut


def centroids(v: DataFrame, least: int) -> DataFrame:
    """Intensity-weighted centre of each slice over voxels above ``least``; slices with too little of it are left out."""
    s = v.where(F.col("v") > least).groupBy("z").agg(F.sum("v").alias("m"), F.sum(F.col("x") * F.col("v")).alias("sx"), F.sum(F.col("y") * F.col("v")).alias("sy"))
    return s.where(F.col("m") >= 16 * least).select("z", (F.col("sx") / F.col("m")).alias("x"), (F.col("sy") / F.col("m")).alias("y"))


def smoothed(axis: DataFrame) -> DataFrame:
    """Mean of five control points around each; there is one point a slice, so the axis is small enough for one ordered window."""
    w = Window.orderBy("z").rowsBetween(-2, 2)
    return axis.select("z", F.avg("x").over(w).alias("x"), F.avg("y").over(w).alias("y"))


def intervals(axis: DataFrame) -> DataFrame:
    """Neighbouring control points as intervals z0 <= z < z1."""
    w = Window.orderBy("z")
    return axis.select(F.col("z").alias("z0"), F.col("x").alias("x0"), F.col("y").alias("y0"), *(F.lead(c).over(w).alias(c + "1") for c in "zxy")).where("z1 is not null")


def interpolated(points: DataFrame, axis: DataFrame) -> DataFrame:
    """Axis position at each point's z (no extrapolation), by an equi-join on whole z: an interval is sent to each it covers."""
    i = intervals(axis).withColumn("k", F.explode(F.sequence(F.floor("z0"), F.floor("z1"))))
    p = points.select("pt_id", "z", F.floor("z").alias("k"))
    j = p.join(i, "k").where((F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1")))
    f = (F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0"))
    return j.select("pt_id", (F.col("x0") + f * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + f * (F.col("y1") - F.col("y0"))).alias("y"))


def gaussian(axis: DataFrame, sigma: float, n: int) -> DataFrame:
    """Axis at every z of 0..n-1, smoothed along z with weights out to three sigma."""
    r = int(3 * sigma)
    s = axis.select("x", "y", F.col("z").alias("own"), F.explode(F.sequence(F.col("z") - r, F.col("z") + r)).alias("z")).where((F.col("z") >= 0) & (F.col("z") < n))
    d = (F.col("z") - F.col("own")).cast("double")
    w = F.exp(-0.5 * d * d / (sigma * sigma))
    return s.groupBy("z").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))


def nearest_control(points: DataFrame, axis: DataFrame) -> DataFrame:
    """The control point nearest in z to each point, the earlier of two: intervals are split at their middles."""
    w = Window.orderBy("z")
    a = axis.select("z", "x", "y", ((F.lag("z").over(w) + F.col("z")) / 2).alias("lo"), ((F.lead("z").over(w) + F.col("z")) / 2).alias("hi"))
    ends = axis.agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"))
    a = a.crossJoin(F.broadcast(ends))  # one row
    a = a.withColumn("k", F.explode(F.sequence(F.floor(F.coalesce("lo", "z")), F.floor(F.coalesce("hi", "z")))))
    p = points.crossJoin(F.broadcast(ends)).select("pt_id", F.col("z").alias("pz"), F.floor(F.least(F.greatest("z", "zmin"), "zmax")).alias("k"))
    j = p.join(a, "k").where((F.col("lo").isNull() | (F.col("pz") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("pz") <= F.col("hi"))))
    return j.select("pt_id", "z", "x", "y")


def cylinder(x: Column, y: Column, ax: Column, ay: Column) -> tuple[Column, Column]:
    """Distance and angle about the axis."""
    return F.hypot(x - ax, y - ay), F.atan2(y - ay, x - ax)


def wrapped(d: Column) -> Column:
    """An angle in (-pi, pi], from one between two of those."""
    return F.when(d > math.pi, d - 2 * math.pi).when(d <= -math.pi, d + 2 * math.pi).otherwise(d)


def neighbour_windings(cells: DataFrame, full: bool = True) -> DataFrame:
    """Of each cell (seg_id, j, i, theta, wind) the mean over its neighbours (8, or 4) of their winding plus the turn to the cell; links that turn over
    a quarter are cut for 4 neighbours."""
    off = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (full or not (a and b))]
    o = F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in off))
    sent = cells.select("seg_id", "j", "i", F.col("theta").alias("t"), F.col("wind").alias("w"), F.explode(o).alias("o"))
    sent = sent.select("seg_id", (F.col("j") - F.col("o.dj")).alias("j"), (F.col("i") - F.col("o.di")).alias("i"), "t", "w")
    turn = wrapped(F.col("theta") - F.col("t")) / (2 * math.pi)
    near = cells.join(sent, list(CELL)).withColumn("turn", turn)
    if not full:
        near = near.where(F.abs("turn") <= 0.25)
    return near.groupBy(*CELL).agg(F.avg(F.col("w") + F.col("turn")).alias("mean"))


def relaxed_windings(cells: DataFrame, rounds: int, fixed: Column) -> DataFrame:
    """Jacobi rounds of ``neighbour_windings`` over 4 neighbours; cells where ``fixed`` holds keep theirs. ``err`` is the change."""
    now = cells
    for k in range(rounds):
        m = neighbour_windings(now, full=False)
        now = now.join(m, list(CELL), "left").select(*CELL, "theta", F.when(fixed | F.col("mean").isNull(), F.col("wind")).otherwise(F.col("mean")).alias("wind"))
        if k % 4 == 3:
            now = cut(now)
    first = cells.select(*CELL, F.col("wind").alias("w0"))
    return now.join(first, list(CELL)).select(*CELL, "wind", F.abs(F.col("wind") - F.col("w0")).alias("err"))


def normal_equations(obs: DataFrame, columns: list[Column], y: Column, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """A and b of the weighted least squares problem: one aggregation whose result has a number for each pair of unknowns."""
    n = len(columns)
    cells = [F.sum(weight * columns[i] * columns[j]) for i in range(n) for j in range(i, n)] + [F.sum(weight * c * y) for c in columns]
    row = [float(x or 0) for x in obs.agg(*cells).first()]
    a = np.zeros((n, n))
    a[np.triu_indices(n)] = row[: n * (n + 1) // 2]
    return a + np.triu(a, 1).T, np.array(row[n * (n + 1) // 2 :])


#: A fit needs so many observations; its slope is solved for where windings span so much, and a measured one is used where it is at least so large.
LEAST_OBSERVATIONS, LEAST_SPAN, LEAST_MEASURED = 200, 2.5, 4.0
#: A second candidate must beat the first by this share.
BETTER = 0.95


def _spiral(knots: int, depth: float, x: list[float] | None) -> tuple[Column, list[Column], Column]:
    """Of an observation: the interval of knots it is in, what is summed for it (two knots, four harmonics, the winding), and its radius by the solution ``x``."""
    zc = F.least(F.greatest(F.col("z") / (depth / (knots - 1)), F.lit(0.0)), F.lit(knots - 1.0))
    at = F.least(F.floor(zc), F.lit(knots - 2)).cast("int")
    f = zc - at
    phi = [1 - f, f, F.cos("theta"), F.sin("theta"), F.cos(2 * F.col("theta")), F.sin(2 * F.col("theta")), F.col("wind")]
    known = x or [0.0] * (knots + 5)
    r0 = F.array(*map(F.lit, known[:knots]))
    ends = [F.get(r0, at), F.get(r0, at + 1)]
    return at, phi, sum((c * p for c, p in zip([*ends, *map(F.lit, known[knots:])], phi, strict=True)), F.lit(0.0))


def spiral_fit(obs: DataFrame, knots: int, depth: float, rounds: int = 4, measured: float = 0.0, negative: bool = False) -> dict | None:
    """rho = r0(z) + harmonics of theta + omega * wind for ``obs(rho, theta, wind, z)``, by reweighted least squares; r0 is linear between knots, flat beyond them.

    Weights are Cauchy's, on a scale of a quarter of omega; second differences of r0 and all unknowns
    have a small ridge. Omega is solved for where the windings span ``LEAST_SPAN``; else it is the
    ``measured`` one, of either sign, the last fit's first (``negative``): the other must be clearly
    better. ``rms`` is over what lies within half of omega, and ``valid`` says whether the fit may be
    used. None where there are too few observations or omega can't be known.

    Each round is one aggregation by interval of knots, so what comes to the driver is 36 sums for each.
    """
    obs = obs.where("rho >= 1e-9").select("rho", "theta", "wind", "z")
    n, low, high = obs.agg(F.count("*"), F.min("wind"), F.max("wind")).first()
    if n < LEAST_OBSERVATIONS:
        return None
    if high - low >= LEAST_SPAN:
        slopes = [None]
    elif measured >= LEAST_MEASURED:
        slopes = [-measured, measured] if negative else [measured, -measured]
    else:
        return None
    best = None
    for slope in slopes:
        x = None
        for _ in range(rounds):
            at, phi, fitted = _spiral(knots, depth, x)
            weight = F.lit(1.0) if x is None or abs(x[-1]) <= 1e-9 else 1 / (1 + F.pow((F.col("rho") - fitted) / (0.25 * abs(x[-1])), 2))
            target = F.col("rho") - (slope or 0.0) * F.col("wind")
            named = obs.select(at.alias("k"), weight.alias("w"), *(p.alias(f"p{m}") for m, p in enumerate(phi)), target.alias("p7"))
            pairs = [(a, b) for a in range(7) for b in range(a, 8)]
            rows = named.groupBy("k").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(f"p{a}") * F.col(f"p{b}")).alias(f"s{a}_{b}") for a, b in pairs)).collect()  # a row an interval
            size = knots + 5
            m, right, total = np.zeros((size, size)), np.zeros(size), 0.0
            for row in rows:
                place = [row["k"], row["k"] + 1, *range(knots, knots + 5)]
                total += row["w"]
                for a, b in pairs:
                    v = row[f"s{a}_{b}"]
                    if b == 7:
                        right[place[a]] += v
                    else:
                        m[place[a], place[b]] += v
                        if a != b:
                            m[place[b], place[a]] += v
            bent = np.zeros((max(0, knots - 2), size))
            for k in range(knots - 2):
                bent[k, k : k + 3] = (-1.0, 2.0, -1.0)
            m += 1e-2 * total / knots * bent.T @ bent
            if slope is not None:
                m, right = m[:-1, :-1], right[:-1]
            m += 1e-6 * (total / len(m) + 1.0) * np.eye(len(m))
            try:
                np.linalg.cholesky(m)
            except np.linalg.LinAlgError:
                break
            x = [*np.linalg.solve(m, right).tolist(), *([] if slope is None else [slope])]
        if x is None:
            continue
        off = F.col("rho") - _spiral(knots, depth, x)[2]
        rms = obs.agg(F.sqrt(F.avg(F.when(F.abs(off) < 0.5 * abs(x[-1]) + 1e-9, off * off)))).first()[0]
        rms = 1e30 if rms is None else float(rms)
        if best is None or rms < BETTER * best["rms"]:
            best = {"r0": x[:knots], "harmonics": x[knots : knots + 4], "omega": x[-1], "rms": rms, "valid": 2.0 <= abs(x[-1]) <= 120.0 and rms <= 0.5 * abs(x[-1])}
    return best


def upsert(axis: DataFrame, edits: DataFrame) -> DataFrame:
    """Control points after ``edits(seq, z, x, y)``: the last edit of a z wins, and one without a position removes it."""
    last = edits.groupBy("z").agg(F.max(F.struct("seq", "x", "y")).alias("e"))
    kept = axis.join(last, "z", "left_anti").select("z", "x", "y")
    return kept.unionByName(last.select("z", F.col("e.x").alias("x"), F.col("e.y").alias("y")).where("x is not null"))


#: As many edits can be taken back.
SNAPSHOTS = 64


def undone(axis: DataFrame, edits: DataFrame, steps: int) -> DataFrame:
    """Control points as they were before the last ``steps`` of ``edits(seq, z, x, y)``, at most ``SNAPSHOTS`` of them."""
    if not 0 <= steps <= SNAPSHOTS:
        raise ValueError(f"{steps} edits can't be taken back, at most {SNAPSHOTS} can")
    kept = edits.orderBy(F.desc("seq")).limit(steps).agg(F.min("seq")).first()[0] if steps else None
    return upsert(axis, edits if kept is None else edits.where(F.col("seq") < kept))
