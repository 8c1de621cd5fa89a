"""Analytic fixtures and relations that must hold whatever the data."""

import math

import pytest
from pyspark.sql import functions as F

from lamina.operators import axis, index, iterate, labels, sampling, stats, stencil, surface, volume


def grid(spark, shape, f):
    nz, ny, nx = shape
    return spark.createDataFrame([(z, y, x, f(z, y, x)) for z in range(nz) for y in range(ny) for x in range(nx)], "z int, y int, x int, v int")


def plane(spark, seg=0, h=20, w=30, shift=0.0, skip=((4, 5), (10, 3))):
    return spark.createDataFrame([(seg, j, i, 100.0 + 20 * i + shift, 200.0 + 20 * j, 3000.0 + 0.25 * i) for j in range(h) for i in range(w) if (j, i) not in skip], "seg_id int, j int, i int, x double, y double, z double")


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_constant_volume_is_a_fixed_point_of_filters(spark):
    v = grid(spark, (6, 6, 6), lambda z, y, x: 77)
    for out in (stencil.median(v, 1, (6, 6, 6)), stencil.unsharp(v, 2, (6, 6, 6)), stencil.max_pool(v, 1, (6, 6, 6))):
        assert {r["v"] for r in out.collect()} == {77}


def test_tiny_volume_lookup(spark):
    v = grid(spark, (2, 3, 4), lambda z, y, x: 3 * (z * 12 + y * 4 + x))
    assert volume.at(v, 1, 2, 3).first()["v"] == 69
    assert volume.at(v, 1, 0, 0).first()["v"] == 36
    assert volume.at(v, 9, 0, 0).first() is None


def test_identity_resample(spark):
    v = grid(spark, (5, 5, 5), lambda z, y, x: z * 25 + y * 5 + x)
    out = sampling.resampled(v, ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0)), (5, 5, 5))
    assert values(out, "z", "y", "x", "v") == values(v, "z", "y", "x", "v")


def test_affine_algebra():
    m = [[0.5, 0.25, 0, 3], [0, 2, 0.5, -1], [0.25, 0, 1, 7]]
    back = sampling.multiply(m, sampling.inverse(m))
    assert all(abs(back[r][c] - (r == c)) < 1e-12 for r in range(3) for c in range(4))
    with pytest.raises(ValueError):
        sampling.inverse([[1, 0, 0, 0], [2, 0, 0, 0], [0, 0, 1, 0]])


def test_plane_trace_crosses_where_it_must(spark):
    sp = plane(spark, skip=())
    t = surface.plane_trace(sp, (0.0, 0.0, 1.0), 3001.6).collect()
    assert len(t) == 19
    assert all(abs(r["a_gi"] - 6.4) < 1e-9 and abs(r["a_x"] - 228) < 1e-9 for r in t)
    assert surface.plane_trace(sp, (0.0, 0.0, 1.0), 9000.0).count() == 0


def test_twin_segments_overlap_and_far_ones_do_not(spark):
    sp = plane(spark, 0).union(plane(spark, 1)).union(plane(spark, 2, shift=9000.0))
    boxes = surface.tile_boxes(surface.tiles(sp, 4), surface.bounds(sp))
    got = {(r["a"], r["b"]): r["overlap"] for r in index.overlap(boxes, 25.0).collect()}
    assert got[0, 1] > 0.9 and got[1, 0] > 0.9
    assert not any(2 in k and v for k, v in got.items())


def test_near_query_counts_before_the_cut(spark):
    sp = plane(spark, 0).union(plane(spark, 1, shift=100.0)).union(plane(spark, 2, shift=9000.0))
    boxes = surface.tile_boxes(surface.tiles(sp, 4), surface.bounds(sp))
    got = index.near_query(boxes, (100.0, 200.0, 3000.0), 500.0, 1).collect()
    assert [(r["seg_id"], r["hits"]) for r in got] == [(0, 2)]


def test_quality_of_a_plane(spark):
    r = surface.mesh_quality(plane(spark, skip=())).first()
    assert (r["folds"], r["kinks"], r["fill"]) == (0, 0, 1.0) and r["twist2"] < 1e-9


def test_fold_is_cut_from_its_newest_arm(spark):
    xs = [0, 20, 40, 30, 10]
    sp = spark.createDataFrame([(0, 0, i, float(x), 0.0, 0.0, i) for i, x in enumerate(xs)], "seg_id int, j int, i int, x double, y double, z double, gen int")
    out = iterate.excised(sp, surface.bends)
    assert surface.bends(out).where("cos < 0").count() == 0
    assert {r["i"] for r in out.collect()} >= {0, 1, 2}


def test_percentiles(spark):
    s = spark.createDataFrame([("m", k, k) for k in range(1, 101)], "metric string, idx long, ns long")
    r = stats.summary(s).first()
    assert (r["total"] / r["n"], r["p50"], r["p95"], r["p99"], r["max"]) == (50.5, 50, 95, 99, 100)


def test_label_paint_of_one_voxel(spark):
    lab = spark.createDataFrame([], "z int, y int, x int, cls int")
    assert labels.changed(lab, (5.0, 5.0, 5.0), 0.4, 1, (10, 10, 10)).first()["changed"] == 1
    one = labels.painted(lab, (5.0, 5.0, 5.0), 0.4, 1, (10, 10, 10))
    assert values(one, "z", "y", "x", "cls") == [(5, 5, 5, 1)]
    assert labels.painted(one, (5.0, 5.0, 5.0), 2.0, 0, (10, 10, 10)).count() == 0


def test_transfer_ramp(spark):
    tf = {r["v"]: tuple(r)[1:] for r in volume.transfer_table(spark, [(0, 0, 0, 0, 0), (255, 255, 255, 255, 255)]).collect()}
    assert len(tf) == 256 and tf[128] == (128,) * 4


def test_level_choice(spark):
    r = spark.range(1).select(sampling.level_for(F.lit(8192.0), 0.001, 1.0, 8).alias("a"), sampling.level_for(F.lit(0.0), 0.001, 1.0, 8).alias("b")).first()
    assert (r["a"], r["b"]) == (3, 0)


def test_distance_transform_in_blocks_equals_one_block(spark):
    s = grid(spark, (20, 20, 20), lambda z, y, x: int((z * 7 + y * 3 + x) % 97 == 0)).where("v > 0")
    a = stencil.distance_transform(s, (20, 20, 20), core=8, border=12)
    b = stencil.distance_transform(s, (20, 20, 20), core=20, border=20)
    assert values(a, "z", "y", "x", "d2") == values(b, "z", "y", "x", "d2")


def test_spiral_fit_finds_omega(spark):
    rows = [(20 + 0.1 * z + 12.5 * w + t, t, w + t / (2 * math.pi), float(z)) for z in range(0, 60, 3) for w in range(4) for t in (0.0,)]
    rows = [(20 + 0.1 * z + 12.5 * (w + t / (2 * math.pi)), t, w + t / (2 * math.pi), float(z)) for z in range(0, 60, 3) for w in range(4) for t in (-3.0, -1.5, 0.0, 1.5, 3.0)]
    rows.append((500.0, 0.0, 1.0, 10.0))
    fit = axis.spiral_fit(spark.createDataFrame(rows, "rho double, theta double, wind double, z double"), 3, 60.0, rounds=12)
    assert abs(fit["omega"] - 12.5) < 1.5 and fit["valid"] and len(fit["r0"]) == 3


def test_spiral_fit_with_a_measured_slope_and_without_one(spark):
    """One winding can't tell the slope from r0: the measured one is taken, with the sign that fits."""
    rows = [(20 + 0.1 * z - 9.0 * t / (2 * math.pi), t, t / (2 * math.pi), float(z)) for z in range(0, 60) for t in (-3.0, -1.5, 0.0, 1.5, 3.0)]
    obs = spark.createDataFrame(rows, "rho double, theta double, wind double, z double")
    fit = axis.spiral_fit(obs, 3, 60.0, measured=9.0)
    assert fit["omega"] == -9.0 and fit["rms"] < 0.1 and fit["valid"]
    assert axis.spiral_fit(obs, 3, 60.0) is None and axis.spiral_fit(obs, 3, 60.0, measured=3.0) is None
    assert axis.spiral_fit(obs.limit(199), 3, 60.0, measured=9.0) is None
    assert axis.spiral_fit(obs.limit(0), 3, 60.0) is None


def test_relaxation_keeps_a_consistent_field(spark):
    cells = spark.createDataFrame([(0, j, i, (0.3 * i + math.pi) % (2 * math.pi) - math.pi, 0.3 * i / (2 * math.pi)) for j in range(4) for i in range(12)], "seg_id int, j int, i int, theta double, wind double")
    assert axis.relaxed_windings(cells, 5, F.lit(False)).agg(F.max("err")).first()[0] < 1e-9
