"""Solvers: what must hold of their results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import flatten, sampling, solve, surface, volume


def test_growth_covers_a_plane(spark):
    targets = spark.createDataFrame([(float(x), float(y), 10.0) for x in range(0, 60) for y in range(0, 60)], "x double, y double, z double")
    seeds = spark.createDataFrame([(0, j, i, 5.0 * i, 5.0 * j, 10.0) for j in range(4, 7) for i in range(4, 7)], "seg_id int, j int, i int, x double, y double, z double")
    out = solve.grown(seeds, targets, 12, 12, 12, 5.0, 2.0)
    assert out.count() == 144
    assert out.where("abs(x - 5 * i) > 1.01 or abs(y - 5 * j) > 1.01 or z != 10").count() == 0
    assert out.agg({"gen": "max"}).first()[0] >= 2


def test_relaxation_pulls_cells_to_the_sheet(spark):
    d = volume.dense_grid(spark, (20, 20, 20)).select("z", "y", "x", F.abs(F.col("z") - 8).alias("v"))
    cells = spark.createDataFrame([(0, j, i, 4.0 + 3 * i, 4.0 + 3 * j, 10.2) for j in range(4) for i in range(4)], "seg_id int, j int, i int, x double, y double, z double")
    out = solve.relaxed(cells, d, 3.0, 10)
    assert out.agg(F.max(F.abs(F.col("z") - 8))).first()[0] < 0.6


def test_potential_of_a_turning_strip(spark):
    cells = spark.createDataFrame([(0, j, i, (0.4 * i + math.pi) % (2 * math.pi) - math.pi) for j in range(3) for i in range(40)], "seg_id int, j int, i int, theta double")
    for r in solve.winding_potential(cells).collect():
        assert abs(r["wind"] - 0.4 * r["i"] / (2 * math.pi)) < 1e-4


def test_flattening_keeps_lengths_and_flips_nothing(spark):
    """A cylinder comes out flat; a bent and bulging sheet loses energy each round and keeps its triangles' turn."""
    pts = [(0, j, i, 50 * math.cos(i / 10), 50 * math.sin(i / 10), 5.0 * j) for j in range(5) for i in range(8)]
    pts += [(1, j, i, 5.0 * i, 5.0 * j, 12 * math.sin(i * 0.9) * math.sin(j * 0.9)) for j in range(7) for i in range(7)]
    sp = spark.createDataFrame([*pts, (0, 20, 20, 0.0, 0.0, 0.0)], "seg_id int, j int, i int, x double, y double, z double")
    uv, told = flatten.flattened(sp, 6.0, 2, 8)
    uv = {(r["seg_id"], r["j"], r["i"]): (r["u"], r["v"]) for r in uv.collect()}
    assert set(uv) == {p[:3] for p in pts}  # a point of no quad has no place
    gap = lambda a, b: math.dist(uv[a], uv[b])
    assert max(abs(gap((0, j, i), (0, j, i + 1)) - 100 * math.sin(0.05)) for j in range(5) for i in range(7)) < 0.05
    turn = lambda a, b, c: (uv[b][0] - uv[a][0]) * (uv[c][1] - uv[a][1]) - (uv[c][0] - uv[a][0]) * (uv[b][1] - uv[a][1])
    for j in range(6):
        for i in range(6):
            assert turn((1, j, i), (1, j, i + 1), (1, j + 1, i)) > 0 and turn((1, j, i + 1), (1, j + 1, i + 1), (1, j + 1, i)) > 0
    rounds = sorted(map(tuple, told.where("seg_id = 1").collect()))
    assert len(rounds) == 2 and all(after < before for _, _, before, after in rounds) and rounds[-1][3] >= 4


def test_totals_reach_cells_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(flatten, "BROADCAST_SEGMENTS", 0)
    df = spark.createDataFrame([(k % 2, k, -k) for k in range(50)], "seg_id int, j int, i int")
    got = flatten.along(df, spark.createDataFrame([(0, 5.0), (1, 7.0)], "seg_id int, t double"), 2)
    assert got.columns == ["seg_id", "j", "i", "t"] and sorted(map(tuple, got.collect())) == sorted((k % 2, k, -k, 5.0 + 2 * (k % 2)) for k in range(50))


def test_registration_finds_a_shift(spark):
    blob = lambda dz, dy, dx: volume.dense_grid(spark, (16, 16, 16)).select("z", "y", "x", F.floor(200 * F.exp(-((F.col("z") - 8 - dz) ** 2 + (F.col("y") - 8 - dy) ** 2 + (F.col("x") - 8 - dx) ** 2) / 18.0)).cast("int").alias("v")).where("v > 0").cache()
    m = solve.registered(blob(0, 0, 0), blob(1, 0, 2), [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], rounds=8)
    x = np.array(m) @ [8, 8, 8, 1]
    assert np.abs(x - [10, 8, 9]).max() < 0.3


def test_picked_surface_passes_through_a_plane(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 50, (60, 2))
    pts = spark.createDataFrame([(float(x), float(y), 0.3 * float(x) + 5) for x, y in p], "x double, y double, z double")
    origin, axes = solve.principal_frame(pts)
    assert np.abs(np.array(axes) @ np.array(axes).T - np.eye(3)).max() < 1e-9
    assert abs(abs(np.dot(axes[2], [-0.3, 0, 1])) - math.sqrt(1.09)) < 1e-6  # the least axis is the plane's normal
    got = solve.picked_surface(pts, origin, axes, 5.0).collect()
    assert len(got) >= 100 and len({(r["j"], r["i"]) for r in got}) == len(got)
    assert max(abs(r["z"] - 0.3 * r["x"] - 5) for r in got) < 1e-6


def test_picked_surface_needs_points_that_span_a_plane(spark):
    kind = "x double, y double, z double"
    frame = (0.0, 0.0, 0.0), ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    assert solve.picked_surface(spark.createDataFrame([], kind), *frame, 5.0).count() == 0
    assert solve.picked_surface(spark.createDataFrame([(float(k), 0.0, 1.0) for k in range(50)], kind), *frame, 5.0).count() == 0


def test_reopened_regions_are_grown_again_and_the_rest_stays(spark):
    """A dent of low confidence in a plane, and a correction on it: the dent comes out flat, all else as it was. A correction by the rim opens nothing."""
    dent = lambda j, i: 8 <= j <= 11 and 8 <= i <= 12
    rows = [(0, j, i, 5.0 * i, 5.0 * j, 11.5 if dent(j, i) else 10.0, 0.2 if dent(j, i) or i > 21 else 0.9, 0.0) for j in range(24) for i in range(24)]
    cells = spark.createDataFrame(rows, "seg_id int, j int, i int, x double, y double, z double, conf double, werr double")
    pts = spark.createDataFrame([(1, 51.0, 49.0, 12.0), (2, 112.0, 60.0, 10.0), (3, 900.0, 0.0, 0.0)], "pt_id long, x double, y double, z double")
    core = {(j, i) for j in range(24) for i in range(24) if dent(j, i)}
    core |= {(j, i) for j in range(8, 13) for i in range(8, 13)}
    assert {(r["j"], r["i"]) for r in solve.reopened(cells, pts, 24, 24, 5, 20.0).collect()} == core
    targets = spark.createDataFrame([(float(x), float(y), 10.0) for x in range(120) for y in range(120)], "x double, y double, z double")
    out = {(r["j"], r["i"]): r for r in solve.reoptimised(cells, pts, targets, 24, 24, 5.0, 2.0, 5, 20.0).collect()}
    assert len(out) == len(rows)
    for _, j, i, x, y, z, _, _ in rows:
        r = out[j, i]
        assert r["z"] == 10.0 and abs(r["x"] - x) < 1.01 and (r["gen"] > 0) == ((j, i) in core)
        assert (j, i) in core or (r["x"], r["y"], r["z"]) == (x, y, z)


def test_lattice_of_an_identity_embedding(spark):
    uv = spark.createDataFrame([(0, j, i, 2.0 * i, 2.0 * j, 2.0 * i, 2.0 * j, 7.0) for j in range(4) for i in range(5)], "seg_id int, j int, i int, u double, v double, x double, y double, z double")
    got = solve.lattice_resampled(uv).collect()
    assert len(got) == 9 * 7 and all((r["x"], r["y"], r["z"]) == (r["lu"], r["lv"], 7.0) for r in got)


def test_donors(spark):
    d = spark.createDataFrame([(k, float(k * k)) for k in range(1, 101)], "pt_id int, d2 double")
    r = solve.donor_agreement(d, 200).first()
    assert (r["n"], r["mean"], r["p95"], r["coverage"]) == (100, 50.5, 95.0, 0.5)
    m = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.1, 1.0), (1, 9.0, 1.0)], "donor_id int, cell_wind double, donor_wind double")
    r = solve.donor_offsets(m).first()
    assert abs(r["offset"] - 1.1) < 1e-9 and r["members"] == 2
