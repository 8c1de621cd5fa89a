"""Flattening: plane embeddings of segments that keep triangles as they are, by reweighted least squares.

A round takes the symmetric Dirichlet energy of every triangle and puts a quadratic one in its place
that has the same slope: the triangle's Jacobian is to be its nearest rotation, with a 2 by 2 weight
from its singular values (closed forms of columns). The sum of these over triangles is one sparse
symmetric system, at most seven blocks of 2 by 2 a vertex, kept with the vertex. It is solved by
preconditioned conjugate gradients: a product sends each vertex's value to its neighbours and sums by
cell, and both inner products of a step come from one aggregation by segment. The embedding then moves
along the solution's direction, at most eight tenths of the way to the first flip of any triangle (the
least root of a quadratic each), halved until the energy falls.

So a segment of any size is dealt over tasks by its cells; only sums come together by segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.surface import CELL, CORNERS, around, cross, dot, length, quads, sub
from lamina.session import by_shuffle, cut

#: Least singular value, halvings of a step, and the fall of energy that ends the rounds.
LEAST_SIGMA, HALVINGS, SLOW = 1e-4, 24, 1e-4
TRIANGLES = (("p00", "p10", "p01"), ("p10", "p11", "p01"))
#: Neighbours of a vertex in the triangulation, itself first.
OFFSETS = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1))
#: Segments whose sums may be broadcast, and the parts a segment's cells are dealt in where there are more.
BROADCAST_SEGMENTS, PARTS = 100_000, 64


def along(df: DataFrame, totals: DataFrame, segments: int) -> DataFrame:
    """Rows of ``df`` with the columns of their segment's one row of ``totals``, without bringing a segment's rows together."""
    if segments <= BROADCAST_SEGMENTS:
        return df.join(F.broadcast(totals), "seg_id")
    parts = totals.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return df.withColumn("_part", F.pmod(F.hash("j", "i"), F.lit(PARTS))).join(by_shuffle(parts), ["seg_id", "_part"]).drop("_part")


def rest_shapes(sp: DataFrame) -> DataFrame:
    """Of each quad its triangles ``t0`` and ``t1``: area and the inverse of the edges' matrix in the triangle's plane (b0, b1; 0, b3); null where degenerate."""

    def one(a: str, b: str, c: str) -> Column:
        e1, e2 = sub(b, a), sub(c, a)
        l1 = length(e1)
        px = dot(e1, e2) / l1
        py2 = dot(e2, e2) - px * px
        py = F.sqrt(py2)
        det = l1 * py
        return F.when((l1 >= 1e-9) & (py2 >= 1e-12), F.struct((py / det).alias("b0"), (-px / det).alias("b1"), (l1 / det).alias("b3"), (0.5 * det).alias("area")))

    return quads(sp).select(*CELL, *(one(*t).alias(f"t{k}") for k, t in enumerate(TRIANGLES))).where("t0 is not null or t1 is not null")


def _shaped(rest: DataFrame, uv: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row for each triangle: cell, ``k``, its rest shape ``s``, and the structs ``a``, ``b``, ``c`` of its corners."""
    q = around(uv, CORNERS, (), columns).join(by_shuffle(rest), list(CELL))
    t = F.array(*(F.when(F.col(f"t{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("s"), *(F.col(p).alias(n) for p, n in zip(names, "abc", strict=True)))) for k, names in enumerate(TRIANGLES)))
    return q.select(*CELL, F.explode(F.array_compact(t)).alias("t")).select(*CELL, "t.*")


def jacobian(u: str, v: str) -> list[Column]:
    """The map from the triangle's plane to the coordinates (u, v) of its corners, row by row."""
    d = lambda p, c: F.col(f"{p}.{c}") - F.col(f"a.{c}")
    b0, b1, b3 = (F.col(f"s.{x}") for x in ("b0", "b1", "b3"))
    return [d("b", u) * b0, d("b", u) * b1 + d("c", u) * b3, d("b", v) * b0, d("b", v) * b1 + d("c", v) * b3]


def singular_values(j: list[Column]) -> tuple[Column, Column]:
    """Signed singular values of a 2 by 2 matrix, as half the sum and half the difference of them: the second is negative where it mirrors."""
    return F.hypot(j[0] + j[3], j[2] - j[1]) / 2, F.hypot(j[0] - j[3], j[1] + j[2]) / 2


def reweighted(triangles: DataFrame) -> DataFrame:
    """Triangles with ``w00``, ``w01``, ``w11`` and the weighted rotation ``r0`` to ``r3``, both times the area."""
    named = triangles.select("*", *(x.alias(f"j{k}") for k, x in enumerate(jacobian("u", "v"))))
    j = [F.col(f"j{k}") for k in range(4)]
    h1, h2 = singular_values(j)
    named = named.select("*", h1.alias("h1"), h2.alias("h2"))

    def weight(s: Column) -> Column:
        s = F.greatest(s, F.lit(LEAST_SIGMA))
        return F.when(F.abs(s - 1) < 1e-8, F.lit(4.0)).otherwise(F.greatest((s - 1 / (s * s * s)) / (s - 1), F.lit(1e-8)))

    named = named.select("*", weight(F.col("h1") + F.col("h2")).alias("y0"), weight(F.col("h1") - F.col("h2")).alias("y1"))
    mean, gap = (F.col("y0") + F.col("y1")) / 2, 2 * F.col("h1") * F.col("h2")
    tilt = F.when(gap > 1e-12, (F.col("y0") - F.col("y1")) / 2 / gap).otherwise(0.0)
    skew = (j[0] * j[0] + j[1] * j[1] - j[2] * j[2] - j[3] * j[3]) / 2
    area = F.col("s.area")
    w = {"w00": area * (mean + tilt * skew), "w01": area * tilt * (j[0] * j[2] + j[1] * j[3]), "w11": area * (mean - tilt * skew)}
    c, s = (j[0] + j[3]) / (2 * F.col("h1")), (j[2] - j[1]) / (2 * F.col("h1"))
    named = named.select(*CELL, "k", "s", *(e.alias(n) for n, e in w.items()), c.alias("c"), s.alias("sn"))
    r = ["w00 * c + w01 * sn", "w01 * c - w00 * sn", "w01 * c + w11 * sn", "w11 * c - w01 * sn"]
    return named.select(*CELL, "k", "s", "w00", "w01", "w11", *(F.expr(e).alias(f"r{n}") for n, e in enumerate(r)))


def system(weighted: DataFrame) -> DataFrame:
    """Of each vertex ``near``, its row of the matrix as (dj, di, w00, w01, w11), and the right side ``bu``, ``bv``."""
    place = {0: ((0, 0), (0, 1), (1, 0)), 1: ((0, 1), (1, 1), (1, 0))}
    g = [("(-s.b0)", "(-s.b1 - s.b3)"), ("s.b0", "s.b1"), ("0e0", "s.b3")]  # the slope of each corner's hat function
    rows = []
    for k, at in place.items():
        parts = []
        for a in range(3):
            for b in range(3):
                o = OFFSETS.index((at[b][0] - at[a][0], at[b][1] - at[a][1]))
                f = f"({g[a][0]} * {g[b][0]} + {g[a][1]} * {g[b][1]})"
                right = [f"r{2 * n} * {g[a][0]} + r{2 * n + 1} * {g[a][1]}" if a == b else "0e0" for n in (0, 1)]
                parts.append(f"struct(j + {at[a][0]} AS j, i + {at[a][1]} AS i, {o} AS o, {f} * w00 AS w00, {f} * w01 AS w01, {f} * w11 AS w11, {right[0]} AS bu, {right[1]} AS bv)")
        rows.append(f"array({', '.join(parts)})")
    sent = weighted.select("seg_id", F.expr(f"inline(CASE WHEN k = 0 THEN {rows[0]} ELSE {rows[1]} END)"))
    sums = [F.sum(F.when(F.col("o") == o, F.col(w)).otherwise(0.0)).alias(f"{w}_{o}") for o in range(len(OFFSETS)) for w in ("w00", "w01", "w11")]
    near = F.array(*(F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di"), *(F.col(f"{w}_{o}").alias(w) for w in ("w00", "w01", "w11"))) for o, (dj, di) in enumerate(OFFSETS)))
    return sent.groupBy(*CELL).agg(*sums, F.sum("bu").alias("bu"), F.sum("bv").alias("bv")).select(*CELL, near.alias("near"), "bu", "bv")


def product(rows: DataFrame, u: str, v: str) -> DataFrame:
    """The matrix times the vector (u, v): ``qu`` and ``qv`` of each cell."""
    sent = rows.select("seg_id", "j", "i", F.col(u).alias("pu"), F.col(v).alias("pv"), F.explode("near").alias("n"))
    to = sent.select("seg_id", (F.col("j") + F.col("n.dj")).alias("j"), (F.col("i") + F.col("n.di")).alias("i"), F.expr("n.w00 * pu + n.w01 * pv").alias("qu"), F.expr("n.w01 * pu + n.w11 * pv").alias("qv"))
    return to.groupBy(*CELL).agg(F.sum("qu").alias("qu"), F.sum("qv").alias("qv"))


def solved(rows: DataFrame, segments: int, steps: int, tol: float = 1e-10) -> DataFrame:
    """``su``, ``sv`` of each cell of ``rows`` (near, bu, bv, u, v): conjugate gradients from (u, v) for all segments at once, until each one's residual is small."""
    zero = F.lit(0.0)
    keep = [*CELL, "u", "v", "near"]
    start = rows.join(by_shuffle(product(rows, "u", "v")), list(CELL))
    start = start.select(*keep, F.col("u").alias("su"), F.col("v").alias("sv"), (F.col("bu") - F.col("qu")).alias("ru"), (F.col("bv") - F.col("qv")).alias("rv"), *(zero.alias(c) for c in ("pu", "pv", "gu", "gv")), (F.col("bu") ** 2 + F.col("bv") ** 2).alias("bb"))
    scale = cut(start.groupBy("seg_id").agg((F.sum("bb") * tol + 1e-30).alias("tol")))
    now, last = start.drop("bb"), scale.select("seg_id", "tol", zero.alias("gamma"), zero.alias("alpha"), F.lit(True).alias("on"))
    for k in range(steps):
        z = [F.col(f"r{c}") / (1e-12 + F.col("near")[0][w]) for c, w in (("u", "w00"), ("v", "w11"))]
        with_z = now.select("*", z[0].alias("zu"), z[1].alias("zv"))
        with_q = cut(with_z.join(by_shuffle(product(with_z, "zu", "zv")), list(CELL)))
        sums = with_q.groupBy("seg_id").agg(F.sum(F.expr("ru * zu + rv * zv")).alias("g"), F.sum(F.expr("qu * zu + qv * zv")).alias("d"), F.sum(F.expr("ru * ru + rv * rv")).alias("rr"))
        beta = F.lit(0.0) if not k else F.when(F.col("gamma") > 0, F.col("g") / F.col("gamma")).otherwise(0.0)
        step = last.drop("beta").join(sums, "seg_id").select("*", beta.alias("beta"))
        under = F.col("d") - F.when(F.col("alpha") > 0, F.col("beta") * F.col("g") / F.col("alpha")).otherwise(0.0)
        step = step.select("seg_id", "tol", "g", "beta", under.alias("under"), (F.col("on") & (F.col("rr") >= F.col("tol")) & (under > 0)).alias("on"))
        last = cut(step.select("seg_id", "tol", F.col("g").alias("gamma"), F.when(F.col("on"), F.col("g") / F.col("under")).otherwise(0.0).alias("alpha"), F.when(F.col("on"), F.col("beta")).otherwise(0.0).alias("beta"), "on"))
        moved = along(with_q, last.select("seg_id", "alpha", "beta"), segments)
        moved = moved.select(*keep, "su", "sv", "ru", "rv", *(F.expr(f"z{c} + beta * p{c}").alias(f"p{c}") for c in "uv"), *(F.expr(f"q{c} + beta * g{c}").alias(f"g{c}") for c in "uv"), "alpha")
        now = moved.select(*keep, *(F.expr(f"s{c} + alpha * p{c}").alias(f"s{c}") for c in "uv"), *(F.expr(f"r{c} - alpha * g{c}").alias(f"r{c}") for c in "uv"), "pu", "pv", "gu", "gv")
        if last.where("on").isEmpty():
            break
    return now.select(*CELL, "u", "v", "su", "sv")


def _dirichlet(t: str) -> str:
    """SQL of a triangle's energy after a share ``t`` of the way: ``jj``, ``jd``, ``dd`` are products of the Jacobian and the direction's, ``c0 + c1 t + c2 t**2`` its determinant."""
    n, det = f"(jj + 2 * {t} * jd + {t} * {t} * dd)", f"(c0 + {t} * c1 + {t} * {t} * c2)"
    least = f"(sqrt(greatest({n} + 2 * {det}, 0e0)) - sqrt(greatest({n} - 2 * {det}, 0e0))) / 2"
    return f"CASE WHEN {det} <= 0 OR {least} < {LEAST_SIGMA} THEN 1e30 ELSE area * {n} * (1 + 1 / ({det} * {det})) END"


#: Columns of a triangle and its direction of movement.
_TERMS = {
    "jj": "j0 * j0 + j1 * j1 + j2 * j2 + j3 * j3",
    "jd": "j0 * d0 + j1 * d1 + j2 * d2 + j3 * d3",
    "dd": "d0 * d0 + d1 * d1 + d2 * d2 + d3 * d3",
    "c0": "j0 * j3 - j1 * j2",
    "c1": "j0 * d3 + d0 * j3 - j1 * d2 - d1 * j2",
    "c2": "d0 * d3 - d1 * d2",
}
#: The least positive root of the determinant, or null: SQL on c0, c1, c2.
_ROOTS = [
    "CASE WHEN abs(c2) < 1e-14 AND abs(c1) > 1e-14 THEN -c0 / c1 END",
    "CASE WHEN abs(c2) >= 1e-14 AND c1 * c1 - 4 * c2 * c0 >= 0 THEN (-c1 - sqrt(c1 * c1 - 4 * c2 * c0)) / (2 * c2) END",
    "CASE WHEN abs(c2) >= 1e-14 AND c1 * c1 - 4 * c2 * c0 >= 0 THEN (-c1 + sqrt(c1 * c1 - 4 * c2 * c0)) / (2 * c2) END",
]


def moved(rest: DataFrame, rows: DataFrame, segments: int) -> tuple[DataFrame, DataFrame]:
    """(cells with their new ``u`` and ``v``; of each segment ``before``, ``after`` and ``done``): a step from (u, v) towards (su, sv) without a flip."""
    rows = cut(rows.select(*CELL, "u", "v", (F.col("su") - F.col("u")).alias("du"), (F.col("sv") - F.col("v")).alias("dv")))
    t = _shaped(rest, rows, ("u", "v", "du", "dv"))
    t = t.select("seg_id", "j", "i", F.col("s.area").alias("area"), *(x.alias(f"j{k}") for k, x in enumerate(jacobian("u", "v"))), *(x.alias(f"d{k}") for k, x in enumerate(jacobian("du", "dv"))))
    t = cut(t.select(*CELL, "area", *(F.expr(e).alias(n) for n, e in _TERMS.items())))
    roots = F.array_min(F.filter(F.array(*map(F.expr, _ROOTS)), lambda r: r > 1e-12))
    limit = cut(t.groupBy("seg_id").agg(F.sum("area").alias("all"), F.sum(F.expr(_dirichlet("0e0"))).alias("e"), F.min(roots).alias("root")).select("seg_id", "all", "e", F.least(F.lit(1.0), F.coalesce(0.8 * F.col("root"), F.lit(1.0))).alias("t")))
    tried = along(t, limit.select("seg_id", "t"), segments).groupBy("seg_id").agg(*(F.sum(F.expr(_dirichlet(f"(t * {0.5**k!r}D)"))).alias(f"e{k}") for k in range(HALVINGS)))
    first = F.coalesce(*(F.when(F.col(f"e{k}") < F.col("e"), F.struct((F.col("t") * 0.5**k).alias("t"), F.col(f"e{k}").alias("e"))) for k in range(HALVINGS)), F.struct(F.lit(0.0).alias("t"), F.col("e").alias("e")))
    chosen = limit.join(tried, "seg_id").select("seg_id", "all", "e", first.alias("to"))
    fall = (F.col("e") - F.col("to.e")) / F.col("all") / (F.col("e") / F.col("all") - 4 + 1e-12)
    chosen = cut(chosen.select("seg_id", (F.col("e") / F.col("all")).alias("before"), (F.col("to.e") / F.col("all")).alias("after"), F.col("to.t").alias("t"), ((F.col("to.t") == 0) | (fall < SLOW)).alias("done")))
    out = along(rows, chosen.select("seg_id", "t"), segments).select(*CELL, F.expr("u + t * du").alias("u"), F.expr("v + t * dv").alias("v"))
    return out, chosen.select("seg_id", "before", "after", "done")


def flattened(sp: DataFrame, step: float, rounds: int = 20, steps: int = 400) -> tuple[DataFrame, DataFrame]:
    """(``seg_id, j, i, u, v``, a plane embedding of every segment, its least u and v 0; of each round and segment the mean energy ``before`` and ``after``, 4 where nothing is stretched).

    Cells that belong to no whole quad aren't in it. ``step`` is the distance of neighbours in the first embedding, the grid itself.
    """
    rest = cut(rest_shapes(sp.select(*CELL, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z")))))
    corner = F.explode(F.array(*(F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj, di in CORNERS.values())))
    cells = rest.select(*CELL, corner.alias("o")).select("seg_id", (F.col("j") + F.col("o.dj")).alias("j"), (F.col("i") + F.col("o.di")).alias("i")).distinct()
    uv = cut(cells.select(*CELL, (F.col("i") * float(step)).alias("u"), (F.col("j") * float(step)).alias("v")))
    segments = uv.select("seg_id").distinct().count()
    told = None
    still, settled = uv, None
    for k in range(rounds):
        matrix = system(reweighted(_shaped(rest, still, ("u", "v"))))
        rows = cut(still.join(by_shuffle(matrix), list(CELL)))
        now, state = moved(rest, solved(rows, segments, steps), segments)
        said = state.select(F.lit(k).alias("round"), "seg_id", "before", "after")
        told = said if told is None else told.union(said)
        now = cut(along(now, state.select("seg_id", "done"), segments))
        ended = now.where("done").drop("done")
        settled = ended if settled is None else settled.union(ended)
        still = now.where("not done").drop("done")
        if still.isEmpty():
            break
    uv = still if settled is None else settled.union(still)
    least = uv.groupBy("seg_id").agg(F.min("u").alias("lu"), F.min("v").alias("lv"))
    out = along(uv, least, segments).select(*CELL, (F.col("u") - F.col("lu")).alias("u"), (F.col("v") - F.col("lv")).alias("v"))
    return out, told if told is not None else sp.sparkSession.createDataFrame([], "round int, seg_id int, before double, after double")
