"""Residual terms of surface cells, with weight 1: what a solver would make small, as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators import index, sampling
from lamina.operators.surface import CELL, XYZ, around, cross, dot, normals, quads, sub
from lamina.session import by_shuffle, cut, saved


def _turn(a: str, b: str, c: str) -> Column:
    """Cosine of the turn at b between the edges a to b and b to c; null where one is missing or has no length."""
    d1, d2 = sub(b, a), sub(c, b)
    l2 = dot(d1, d1) * dot(d2, d2)
    return F.when(l2 > 1e-24, dot(d1, d2) / F.sqrt(l2))


def hinges(sp: DataFrame, bend_cos: float, fold_cos: float = 0.0) -> DataFrame:
    """Along both grid axes: ``bend``, the cosine missing to the bound of the material, linear and four times its square; ``fold``, that missing to a right
    angle; ``curv``, the squared third difference of four cells in a row. Terms inside their bound are 0, those without enough neighbours null."""
    o = {"p": (0, 0)} | {f"{n}{k}": (d, 0) if k else (0, d) for k in (0, 1) for n, d in (("a", -1), ("c", 1), ("d", 2))}
    n = around(sp, o).where("p is not null")
    out = []
    for k, name in ((0, "i"), (1, "j")):
        cosine = _turn(f"a{k}", "p", f"c{k}")
        pen = F.greatest(F.lit(0.0), bend_cos - cosine)
        third = [F.col(f"a{k}.{c}") - 3 * F.col(f"p.{c}") + 3 * F.col(f"c{k}.{c}") - F.col(f"d{k}.{c}") for c in XYZ]
        out += [F.when(cosine.isNotNull(), pen + 4 * pen * pen).alias(f"bend_{name}"), F.when(cosine.isNotNull(), F.greatest(F.lit(0.0), fold_cos - cosine)).alias(f"fold_{name}"), dot(third, third).alias(f"curv_{name}")]
    return n.select(*CELL, *out)


def space_line(sp: DataFrame, distance: DataFrame, steps: int) -> DataFrame:
    """``space``: the mean of ``distance(z, y, x, v)`` at the inner points of each cell's edge to the next one in its row."""
    n = around(sp, {"p": (0, 0), "r": (0, 1)}).where("p is not null and r is not null")
    f = F.col("k") / F.lit(float(steps))
    at = n.select(*CELL, "p", "r", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("k"))
    points = at.select(F.struct(*CELL, "k").alias("pt_id"), *((F.col(f"p.{c}") * (1 - f) + F.col(f"r.{c}") * f).alias(c) for c in XYZ))
    return sampling.trilinear(points, distance).select("pt_id.*", "value").groupBy(*CELL).agg(F.avg("value").alias("space"))


def _off_spiral(x: Column, y: Column, z: Column, wind: Column, fit: dict, axis: tuple[float, float], depth: float) -> tuple[Column, Column]:
    """Radius about a straight axis, and how far it is from a spiral fit (see ``axis.spiral_fit``)."""
    knots = len(fit["r0"])
    step = depth / (knots - 1)
    r0 = sum((float(r) * F.greatest(F.lit(0.0), 1 - F.abs(z / step - k)) for k, r in enumerate(fit["r0"])), F.lit(0.0))
    ux, uy = x - axis[0], y - axis[1]
    th = F.atan2(uy, ux)
    a, b, c, d = fit["harmonics"]
    h = a * F.cos(th) + b * F.sin(th) + c * F.cos(2 * th) + d * F.sin(2 * th)
    rho = F.sqrt(ux * ux + uy * uy)
    return rho, rho - (r0 + h + fit["omega"] * wind)


def winding(cells: DataFrame, fit: dict, axis: tuple[float, float], depth: float) -> DataFrame:
    """``wind_term``: how far each cell (seg_id, j, i, x, y, z, wind) is from a spiral fit, in windings, made robust: r / sqrt(1 + r * r)."""
    rho, off = _off_spiral(*(F.col(c) for c in (*XYZ, "wind")), fit, axis, depth)
    r = off / abs(fit["omega"])
    return cells.where(rho >= 1e-6).select(*CELL, (r / F.sqrt(1 + r * r)).alias("wind_term"))


#: Families of planes: the two axes of their slices, and the one across.
PLANES = {"xy": "xyz", "xz": "xzy", "yz": "yzx"}
#: A quad's corners, seen from each: itself, its two neighbours in the order they are tried, the opposite one.
TURNS = (("p00", "p10", "p01", "p11"), ("p11", "p01", "p10", "p00"), ("p10", "p11", "p00", "p01"), ("p01", "p00", "p11", "p10"))
CHORD = [*CELL, "turn", "plane"]
#: Weights of both parts of the term, the radius of its evidence and that of its candidates, and how near both ends of a chord must come to a path.
W_NORMAL, W_SNAP, EVIDENCE, CANDIDATES, TRIGGER, RANGE = 10.0, 0.1, 64.0, 80.0, 4.0, 16.0


def _fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """With more columns, which a filter above doesn't compute again: it can't be pushed below the array that they come from."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def chords(sp: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Where the slice through a corner of a quad crosses it: for each corner (``turn``) and plane family the chord from the corner (au, av) to the diagonal
    side (eu, ev), and ``weight``, half the squared sine between the quad and the slice. Quads on one side of the slice have none."""
    each = []
    for k, names in enumerate(TURNS):
        for plane, (u, v, w) in PLANES.items():
            corner = [F.struct(*(F.col(f"{p}.{c}").alias(n) for c, n in ((u, "u"), (v, "v"), (w, "w")))).alias(n) for p, n in zip(names, ("a", "b1", "b2", "c"), strict=True)]
            each.append(F.struct(F.lit(k).alias("turn"), F.lit(plane).alias("plane"), *corner, *(F.col(f"{names[0]}.{e}").alias(e) for e in extra)))
    q = quads(sp, extra).select(*CELL, F.inline(F.array(*each)))
    q = _fixed(q, {n: F.col(f"{m}.w") - F.col("a.w") for n, m in (("r1", "b1"), ("r2", "b2"), ("rc", "c"))})
    pick = F.when(F.abs("rc") < 1e-9, F.when(F.abs("r1") > 1e-9, 1).when(F.abs("r2") > 1e-9, 2)).otherwise(F.when(F.col("r1") * F.col("rc") <= 0, 1).when(F.col("r2") * F.col("rc") <= 0, 2))
    q = q.where("not (r1 > 0 and r2 > 0 and rc > 0) and not (r1 < 0 and r2 < 0 and rc < 0)")
    q = _fixed(q, {"pick": pick}).where("pick is not null")
    q = _fixed(q, {"b": F.when(F.col("pick") == 1, F.col("b1")).otherwise(F.col("b2")), "rb": F.when(F.col("pick") == 1, F.col("r1")).otherwise(F.col("r2"))})
    q = _fixed(q.where("abs(rb - rc) >= 1e-9"), {"t": F.try_divide(-F.col("rc"), F.col("rb") - F.col("rc"))})
    one, two = ([F.col(f"b.{x}") - F.col(f"{m}.{x}") for x in "uvw"] for m in ("a", "c"))
    n = cross(one, two)
    q = _fixed(q, {"n2": dot(n, n), "nw": n[2], "eu": F.expr("c.u + t * (b.u - c.u)"), "ev": F.expr("c.v + t * (b.v - c.v)"), "au": F.col("a.u"), "av": F.col("a.v")})
    q = _fixed(q, {"len": F.expr("sqrt((eu - au) * (eu - au) + (ev - av) * (ev - av))")}).where("n2 >= 1e-18 and len >= 1e-9")
    return q.select(*CHORD, F.round("a.w").cast("int").alias("slice"), "au", "av", "eu", "ev", "len", F.expr("0.5 * (1 - try_divide(nw * nw, n2))").alias("weight"), *extra)


def _from_line(pu: Column, pv: Column, au: Column, av: Column, bu: Column, bv: Column) -> Column:
    """Squared distance of a point from a line between two places."""
    du, dv = bu - au, bv - av
    l2 = du * du + dv * dv
    t = F.when(l2 > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((pu - au) * du + (pv - av) * dv, l2)))).otherwise(0.0)
    qu, qv = au + t * du - pu, av + t * dv - pv
    return qu * qu + qv * qv


def alignment(sp: DataFrame, lines: DataFrame, spiral: tuple[dict, tuple[float, float], float] | None = None) -> DataFrame:
    """``align_term`` of each chord (see ``chords``) that has paths of its own slice about it (``lines``: see ``paths.slice_lines``).

    Its first part is how much the chord's normal turns from those of the steps of paths around its
    middle, weighed by their nearness. Its second draws the chord onto one path: among steps that the
    chord's far end comes near and whose neighbour on the same path its corner comes near, the one
    where both are nearest counts, ties going to the smaller loss; without one the loss is whole. With
    a ``spiral`` (fit, axis, depth), and the windings ``wind`` of ``sp``, steps on another winding
    don't count for the second part. Chords without a step around have no row.

    Chords and steps meet in square buckets of their slice: for the first part a step is in one and a
    chord in four at most, and the sums are combined before they are shuffled; for the second only a
    chord's far end meets the steps about it.
    """
    tasks = int(sp.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but each chord meets many steps
    ch = cut(chords(sp, ("wind",) if spiral else ()).repartition(tasks, *CHORD))
    ch = ch.withColumns({"mu": (F.col("au") + F.col("eu")) / 2, "mv": (F.col("av") + F.col("ev")) / 2})
    st = lines.withColumns({"su": F.expr("(u0 + u1) / 2"), "sv": F.expr("(v0 + v1) / 2"), "tu": F.expr("u1 - u0"), "tv": F.expr("v1 - v0")})
    st = saved(_fixed(st, {"tl": F.expr("sqrt(tu * tu + tv * tv)")}).where("tl >= 1e-6"))  # both parts take them: files are decoded once
    d2 = F.expr("(su - mu) * (su - mu) + (sv - mv) * (sv - mv)")

    def spread(df: DataFrame, side: float, low: dict[str, Column], high: dict[str, Column]) -> DataFrame:
        for c in low:
            df = df.withColumn("b" + c, F.explode(F.sequence(F.floor(low[c] / side), F.floor(high[c] / side))))
        return df

    around_ = {c: F.col("m" + c) for c in "uv"}
    one = spread(ch, 2 * EVIDENCE, {c: m - EVIDENCE for c, m in around_.items()}, {c: m + EVIDENCE for c, m in around_.items()})
    two = st.withColumns({f"b{c}": F.floor(F.col(f"s{c}") / (2 * EVIDENCE)) for c in "uv"})
    both = one.join(by_shuffle(two.select("plane", "slice", "bu", "bv", "su", "sv", "tu", "tv", "tl")), ["plane", "slice", "bu", "bv"])
    turned = 1 - F.abs(F.expr("try_divide(ev - av, len) * try_divide(-tv, tl) + try_divide(au - eu, len) * try_divide(tu, tl)"))
    both = _fixed(both.where(d2 <= EVIDENCE * EVIDENCE), {"turned": turned, "w": 1 / F.greatest(F.lit(10.0), d2)})
    sums = both.groupBy(*CHORD).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("turned")).alias("s"), F.max("weight").alias("weight"))

    side = 8 * TRIGGER
    ends = spread(ch, side, {c: F.col("e" + c) - TRIGGER for c in "uv"}, {c: F.col("e" + c) + TRIGGER for c in "uv"})
    steps = spread(st, side, {c: F.least(c + "0", c + "1") for c in "uv"}, {c: F.greatest(c + "0", c + "1") for c in "uv"})
    at = {c: F.col(c) for c in ("au", "av", "eu", "ev", "u0", "v0", "u1", "v1", "pu", "pv", "nu", "nv")}
    far = _from_line(at["eu"], at["ev"], at["u0"], at["v0"], at["u1"], at["v1"])
    pairs = _fixed(ends.join(by_shuffle(steps), ["plane", "slice", "bu", "bv"]).where(d2 <= CANDIDATES * CANDIDATES), {"far": far}).where(F.col("far") < TRIGGER * TRIGGER)
    if spiral:
        mid = {"xy": ("su", "sv", "slice"), "xz": ("su", "slice", "sv"), "yz": ("slice", "su", "sv")}
        place = [F.coalesce(*(F.when(F.col("plane") == p, F.col(m[k]).cast("double")) for p, m in mid.items())) for k in range(3)]
        rho, off = _off_spiral(*place, F.col("wind"), *spiral)
        pairs = pairs.where((rho < 1e-6) | (F.abs(off) < 0.45 * abs(spiral[0]["omega"])))
    near = F.array(_from_line(at["au"], at["av"], at["pu"], at["pv"], at["u0"], at["v0"]), _from_line(at["au"], at["av"], at["u1"], at["v1"], at["nu"], at["nv"]))
    pairs = pairs.select(*CHORD, F.sqrt("far").alias("far"), F.explode(near).alias("corner")).where(F.col("corner") < RANGE * RANGE)
    pairs = pairs.select(*CHORD, (F.sqrt("corner") / RANGE).alias("f"), (F.col("far") / TRIGGER).alias("g"))
    best = pairs.groupBy(*CHORD).agg(F.min(F.struct(F.expr("0.5 * (f + g)").alias("score"), F.expr("f * (1 - g) + g").alias("loss"))).alias("best"))
    term = (W_NORMAL * F.col("s") / F.col("w") + W_SNAP * F.coalesce("best.loss", F.lit(1.0))) * F.col("weight")
    return sums.join(by_shuffle(best), CHORD, "left").select(*CHORD, "n", term.alias("align_term"))


def self_approach(sp: DataFrame, least: float, apart: int = 8, far: int = 20) -> DataFrame:
    """``self_term``: (least - d) / least of cells whose surface comes back within ``least``, folded back (normals against each other) or, over ``far``
    grid steps away, going through itself (normals alike); cells without a normal count too."""
    near = index.self_overlap(sp, least, apart)
    n = normals(sp)
    one = n.select(*CELL, *(F.col("n" + c).alias("m" + c) for c in XYZ))
    two = n.select("seg_id", F.col("j").alias("j2"), F.col("i").alias("i2"), *("n" + c for c in XYZ))
    both = near.join(by_shuffle(one), list(CELL), "left").join(by_shuffle(two), ["seg_id", "j2", "i2"], "left")
    along = sum((F.col("m" + c) * F.col("n" + c) for c in XYZ), F.lit(0.0))
    steps = F.greatest(F.abs(F.col("i") - F.col("i2")), F.abs(F.col("j") - F.col("j2")))
    counts = along.isNull() | (along < -0.3) | ((along > 0.3) & (steps > far))
    d = F.sqrt("d2")
    return both.where(counts & (d > 1e-6) & (d < least)).select(*CELL, ((least - d) / least).alias("self_term"))
