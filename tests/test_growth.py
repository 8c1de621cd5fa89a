"""Queries whose cost must not grow faster than their tables, and cells and points at the edge of what there is."""

import pandas as pd

from lamina.functions import derive, hooks
from lamina.operators import geometry, index, residuals, sampling, surface
from lamina.plans import registry, volumes
from lamina.sources import paths

FOLDER = "/root/testdata/sf0.001"


def _parts(tmp_path, cells):
    """A part table with these cells (seg_id, j, i) of size 1 and a price that gives z = 100."""
    rows = [(500 * s + 50 * j + i, 1, 950.0) for s, j, i in cells]
    pd.DataFrame(rows, columns=["p_partkey", "p_size", "p_retailprice"]).astype({"p_size": "int32"}).to_parquet(tmp_path / "part.parquet")
    return str(tmp_path)


def test_a_cell_without_neighbours_has_no_mean(spark, tmp_path):
    folder = _parts(tmp_path, [(0, 2, 3), (0, 2, 4), (1, 5, 5)])
    got = registry.queries()["f6_neighbour_mean_veto"](spark, folder).collect()
    assert sorted(map(tuple, got)) == [(0, 2, 3), (0, 2, 4)]


def test_no_side_of_a_join_is_broadcast_by_its_estimated_size(spark):
    for name in ("j8_self_overlap", "j5_nearest_surface", "j13_line_distance"):
        plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


def test_a_point_is_sampled_by_itself_also_where_its_name_is_not_its_own(spark):
    v = spark.createDataFrame([(0, 0, 0, 8), (0, 0, 1, 16), (4, 4, 4, 80)], "z int, y int, x int, v int")
    points = spark.createDataFrame([(1, 0.25, 0.0, 0.0), (1, 4.0, 4.0, 4.5), (2, 9.0, 9.0, 9.0), (3, -0.5, 0.0, 0.0)], "pt_id long, x double, y double, z double")
    got = sorted(tuple(r) for r in sampling.trilinear(points, v).select("pt_id", "value", "gx", "gz").collect())
    assert got == [(1, 10.0, 8.0, -10.0), (1, 40.0, -40.0, -80.0), (2, 0.0, 0.0, 0.0), (3, 4.0, 8.0, -4.0)]


def test_cells_of_a_small_file_are_dealt_over_tasks(spark, tmp_path):
    folder = _parts(tmp_path, [(s, j, i) for s in range(100) for j in range(10) for i in range(50)])
    sp = derive.surface_points(spark, folder)
    assert sp.rdd.getNumPartitions() == 3 and sp.count() == 50_000
    assert derive.surface_points(spark, FOLDER).rdd.getNumPartitions() == 1


def test_jobs_of_a_trace_do_not_grow_with_its_segments(spark, tmp_path, monkeypatch):
    folder = _parts(tmp_path, [(s, 0, i) for s in range(40) for i in range(3)])
    asked = []
    every = hooks.side_by_side
    monkeypatch.setattr(hooks, "side_by_side", lambda spark, jobs, *a: asked.append(len(jobs)) or every(spark, jobs, *a))
    got = registry.queries()["e7_trace_jobs"](spark, folder).collect()
    assert sorted((r["seg_id"], r["nvalid"], r["x_lo"], r["x_hi"]) for r in got) == [(s, 3, 1.0, 41.0) for s in range(40)]
    assert asked == [8]


def test_grown_hysteresis_reads_its_table_once(spark, monkeypatch):
    asked = []
    every = volumes.sided_voxels
    monkeypatch.setattr(volumes, "sided_voxels", lambda *a: asked.append(a[1:]) or every(*a))
    assert registry.queries()["f9_grown_hysteresis"](spark, FOLDER).count() and asked == [(FOLDER, 32)]


def test_operators_shuffle_both_sides_also_where_the_session_lets_small_ones_be_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "10m")
        sp, points = derive.surface_points(spark, FOLDER), derive.query_points(spark, FOLDER)
        lines = spark.range(9).selectExpr("double(id) x0", "double(id) y0", "double(id + 1) x1", "double(id) y1")
        steps = spark.range(9).selectExpr("'xy' plane", "int(id) slice", "id rec", "0 k", *(f"double(id + {k}) {c}" for k, c in enumerate(("u0", "v0", "u1", "v1"))), *(f"double(id) {c}" for c in ("pu", "pv", "nu", "nv")))
        made = {
            "self_overlap": index.self_overlap(sp, 14.0), "nearest": index.nearest(points, sp, 100.0), "support": index.support(points, sp, 150.0), "line_distance": index.line_distance(points, lines, 32.0),
            "nearest_surface": geometry.nearest_surface(points, surface.quads(sp), 60.0), "self_approach": residuals.self_approach(sp, 14.0), "alignment": residuals.alignment(sp, steps),
        }
        for name, df in made.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan, name
            assert "BroadcastHashJoin" not in plan, name
    finally:
        for n, was in before.items():
            spark.conf.set(n, was) if was is not None else spark.conf.unset(n)


def test_slices_are_listed_by_tasks(spark, tmp_path):
    points = spark.createDataFrame([("xy", n, 1, k, 3 * k, n) for n in range(5) for k in range(3)], "plane string, slice int, path_id long, k int, u int, v int")
    paths.write_slices(points, str(tmp_path), {"xy": (64, 64)}, 32)
    (tmp_path / "xy" / "000009.grid").touch()  # no byte, no path
    (tmp_path / "_parts" / "000001.grid").write_bytes(b"left behind")
    got = paths.slice_lines(spark, str(tmp_path))
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString() and not got.inputFiles()
    assert sorted((r["slice"], r["k"], r["u0"], r["u1"], r["pu"], r["nu"]) for r in got.collect()) == sorted(t for n in range(5) for t in [(n, 0, 0.0, 3.0, None, 6.0), (n, 1, 3.0, 6.0, 0.0, None)])
    assert paths.slice_status(spark, str(tmp_path)).count() == 5
