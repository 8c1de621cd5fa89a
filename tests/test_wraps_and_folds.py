"""Adjacent wraps, donors and folds: what must hold of them."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lamina.operators import folds, volume, wraps

POINT = "seg_id int, j int, i int, x double, y double, z double"


def test_the_next_sheet_is_found_behind_the_own_one(spark):
    """Sheets at z 6 and 16, the second with a gap: rays that pass through it miss and are filled from their neighbours."""
    gap = (F.col("x") > 10) & (F.col("x") < 12)
    d = volume.dense_grid(spark, (40, 24, 24)).select("z", "y", "x", F.least(F.abs(F.col("z") - 6), F.when(gap, 9).otherwise(F.abs(F.col("z") - 16))).cast("double").alias("v"))
    cells = spark.createDataFrame([(0, j, i, 3.0 + 2 * i, 3.0 + 2 * j, 6.0) for j in range(9) for i in range(9)], POINT)
    out = wraps.adjacent_wrap(cells, d, (40, 24, 24), F.lit(10.0), 1).collect()
    assert {r["kind"] for r in out} == {1, 3} and len(out) >= 49
    assert all(abs(r["z"] - 16) < 1.01 and (r["conf"] == 0.9) == (r["kind"] == 1) for r in out)
    assert all(abs(r["x"] - 3 - 2 * r["i"]) < 1e-9 for r in out)
    assert wraps.adjacent_wrap(cells, d, (40, 24, 24), F.lit(10.0), -1).count() == 0  # nothing below


def test_nearest_points_of_triangles():
    rng = np.random.default_rng(2)
    p, a, b, c = rng.normal(size=(4, 200, 3))
    d2, s, t = wraps.closest_on_triangle(p, a, b, c)
    assert (s >= -1e-12).all() and (t >= -1e-12).all() and (s + t <= 1 + 1e-12).all()
    best = np.full(200, np.inf)
    for u in np.linspace(0, 1, 60):
        for v in np.linspace(0, 1 - u, 60):
            best = np.minimum(best, ((a + u * (b - a) + v * (c - a) - p) ** 2).sum(1))
    assert (d2 <= best + 1e-9).all() and (np.sqrt(best) - np.sqrt(d2) < 0.1).all()


def test_membership_marks_folds_and_strangers(spark):
    """A donor that doubles back: the cells lie between its halves, and every other row is nearer to the upper one."""
    donor = [(7, j, i, 4.0 * i, 4.0 * j, 0.0, i / 10) for j in range(8) for i in range(12)] + [(7, j, i, 4.0 * (23 - i), 4.0 * j, 3.0, i / 10) for j in range(8) for i in range(12, 24)]
    cells = [(0, j, i, 4.0 * i + 1, 4.0 * j + 1, 1.0 if j % 2 else 2.0, 0.5) for j in range(6) for i in range(4)] + [(1, j, i, 4.0 * i + 1, 4.0 * j + 1, -1.0, i / 10 + 5) for j in range(6) for i in range(6)] + [(2, 0, 0, 500.0, 0.0, 0.0, 0.0)]
    kind = POINT + ", wind double"
    out = wraps.fused(spark.createDataFrame(cells, kind), spark.createDataFrame(donor, kind)).collect()
    assert len(out) == len(cells)
    of = lambda s: [r for r in out if r["seg_id"] == s]
    assert {r["donor"] for r in of(2)} == {-1} and {r["donor"] for r in of(0)} == {-2}
    for r in of(1):
        assert r["donor"] == 7 and abs(r["u"] - r["i"] - 0.25) < 1e-9 and abs(r["v"] - r["j"] - 0.25) < 1e-9
        assert abs(r["dx"] - 4 * r["i"] - 1) < 1e-9 and abs(r["dz"]) < 1e-9 and r["agrees"]


def sheet(spark, rows):
    return spark.createDataFrame(rows, POINT + ", gen int, conf double, anchor boolean")


def test_smooth_sheets_stay_whole(spark):
    flat = [(0, j, i, 5.0 * i, 5.0 * j, 2 * math.sin(i / 3), 1 + i, 0.5, False) for j in range(8) for i in range(12)]
    curl = [(1, j, i, 6 * math.cos(i / 2), 6 * math.sin(i / 2), 3.0 * j, 1 + i, 0.5, False) for j in range(5) for i in range(9)]
    kept, gone = folds.excised(sheet(spark, flat + curl), 3.0)
    assert kept.count() == len(flat) + len(curl) and gone.count() == 0


def test_a_flap_goes_as_a_whole_and_a_second_run_finds_nothing(spark):
    """Columns 10 to 17 lie back over columns 9 to 2, one unit above them; they are the newer arm. An anchor on it stays."""
    rng = random.Random(4)
    at = lambda i: (5.0 * i, 0.0) if i < 10 else (5.0 * (18.6 - i), 1.5)
    rows = [(3, j, i, at(i)[0], 5.0 * j, at(i)[1], 1 + i // 2, rng.random(), False) for j in range(9) for i in range(18)]
    kept, gone = folds.excised(sheet(spark, rows), 5.0)
    left = {(r["j"], r["i"]) for r in kept.collect()}
    assert all((j, i) in left for j in range(9) for i in range(9)) and not any(i > 10 for _, i in left)
    why = {(r["j"], r["i"]): r["why"] for r in gone.collect()}
    assert len(why) + len(left) == len(rows) and set(why.values()) == {"crease", "orphan"}
    again, none = folds.excised(kept, 5.0)
    assert again.count() == len(left) and none.count() == 0
    held = [(*r[:8], r[2] == 14 and r[1] == 4) for r in rows]
    assert (4, 14) in {(r["j"], r["i"]) for r in folds.excised(sheet(spark, held), 5.0)[0].collect()}


def test_a_smooth_turn_back_is_cut_where_the_way_round_is_long(spark):
    """No turn over 90 degrees: the upper layer goes where the way round the bend is four times its height, the bend itself stays."""
    bend = [(30.0, 0.0), (31.0, 0.8), (31.0, 2.2), (30.0, 3.0)]
    at = [(3.0 * i, 0.0) for i in range(10)] + bend + [(30.0 - 3.0 * i, 3.0) for i in range(1, 9)]
    rows = [(0, j, i, x, 3.0 * j, z, 1 + i, 0.5, False) for j in range(7) for i, (x, z) in enumerate(at)]
    kept, gone = folds.excised(sheet(spark, rows), 3.0)
    left = {(r["j"], r["i"]) for r in kept.collect()}
    assert {r["why"] for r in gone.collect()} == {"doubled"}
    assert all((j, i) in left for j in range(7) for i in range(14)) and not any(i > 16 for _, i in left)
    assert folds.excised(kept, 3.0)[1].count() == 0


def test_arms_that_hang_on_a_crease_alone_are_orphans(spark):
    """A sharp turn is cut out; behind it the sheet goes on, smooth and far from the rest, but nothing connects it any more."""
    x = [0, 5, 10, 15, 12, 17, 22, 27, 32]
    rows = [(0, j, i, float(x[i]), 5.0 * j, 30.0 * (i > 3), 1 + i, 0.5, False) for j in range(4) for i in range(9)]
    kept, gone = folds.excised(sheet(spark, [(*r[:5], 0.0, *r[6:]) for r in rows]), 5.0)
    why = {(r["j"], r["i"]): r["why"] for r in gone.collect()}
    assert {r["i"] for r in kept.collect()} <= {0, 1, 2, 3} and "orphan" in why.values()
