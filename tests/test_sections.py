"""Slices of paths as files, and how surfaces lie along them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import residuals as re
from lamina.sources import paths as pt

POINTS = "plane string, slice int, path_id long, k int, u int, v int"
SHEET = "seg_id int, j int, i int, x double, y double, z double, wind double"


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, extents, cell=32):
        path = f"file://{tmp_path}/slices"
        pt.write_slices(spark.createDataFrame(rows, POINTS), path, extents, cell)
        return path

    return write


def test_a_long_step_is_written_as_several_and_ends_where_it_should(spark, folder):
    path = folder([("xy", 3, 1, 0, 500, 400), ("xy", 3, 1, 1, 100, 403), ("xy", 3, 1, 2, 101, 403), ("xy", 3, 2, 0, 7, 9)], {"xy": (600, 500)})
    rows = pt.slice_lines(spark, path).orderBy("rec", "k").collect()
    assert [(r["slice"], r["k"]) for r in rows] == [(3, k) for k in range(5)]
    ends = [(r["u0"], r["v0"]) for r in rows] + [(rows[-1]["u1"], rows[-1]["v1"])]
    assert ends == [(500, 400), (400, 401), (300, 402), (200, 402), (100, 403), (101, 403)]
    assert rows[0]["pu"] is None and rows[4]["nu"] is None
    assert [(r["pu"], r["nu"]) for r in rows[1:4]] == [(500, 200), (400, 100), (300, 101)]
    assert pt.slice_status(spark, path).collect()[0][2:] == ("paths", 2)  # the one of a single point too
    assert pt.slice_buckets(spark, path).where("bx = 0 and by = 0").count() == 1


def test_empty_bad_and_cut_off_files(spark, folder, tmp_path):
    path = folder([("yz", 1, 1, 0, 5, 5), ("yz", 1, 1, 1, 9, 9), ("yz", 1, 2, 0, 50, 50), ("yz", 1, 2, 1, 60, 60)], {"yz": (64, 64)})
    whole = (tmp_path / "slices/yz/000001.grid").read_bytes()
    for k, data in enumerate((b"", b"abc", whole[:4] + b"\0\0\0\2" + whole[8:], whole[:-1])):
        (tmp_path / f"slices/yz/00001{k}.grid").write_bytes(data)
    got = {r["slice"]: (r["status"], r["n"]) for r in pt.slice_status(spark, path).collect()}
    assert got == {1: ("paths", 2), 11: ("bad", 0), 12: ("bad", 0), 13: ("paths", 1)}
    assert sorted(r["slice"] for r in pt.slice_lines(spark, path).collect()) == [1, 1, 13]


def test_negative_places_are_an_error(folder):
    with pytest.raises(Exception, match="negative place"):
        folder([("xy", 0, 1, 0, -1, 0), ("xy", 0, 1, 1, 5, 0)], {"xy": (10, 10)})


def test_paths_are_found_by_the_buckets_of_a_square(spark, folder):
    path = folder([("xy", 0, 1, 0, 10, 10), ("xy", 0, 1, 1, 20, 10), ("xy", 0, 2, 0, 90, 40), ("xy", 0, 2, 1, 60, 10), ("xy", 0, 3, 0, 99, 99)], {"xy": (100, 100)})
    asked = spark.createDataFrame([(1, "xy", 0, 5.0, 5.0), (2, "xy", 0, 25.5, 5.0), (3, "xy", 0, 40.0, 40.0), (4, "xy", 0, -50.0, 5.0), (5, "xz", 0, 5.0, 5.0), (6, "xy", 0, 120.0, 99.0)], "pt_id int, plane string, slice int, u double, v double")
    got = pt.paths_at(pt.slice_buckets(spark, path), asked, 10.0).groupBy("pt_id").agg(F.count("*").alias("n")).collect()
    assert {r["pt_id"]: r["n"] for r in got} == {1: 1, 2: 2, 3: 2}


def sheet(spark):
    return spark.createDataFrame([(0, j, i, 10.0 * i, 0.0, 10.0 * j, 2.0) for j in (0, 1) for i in (0, 1)], SHEET)


def term(spark, points, spiral=None):
    """The term of the quad's first corner in its slice of constant z, by a path of the given points."""
    rows = [("xy", 0, 1, k, *map(float, (*a, *b)), *(map(float, points[k - 1]) if k else (None, None)), *(map(float, points[k + 2]) if k + 2 < len(points) else (None, None))) for k, (a, b) in enumerate(zip(points, points[1:], strict=False))]
    lines = spark.createDataFrame(rows, pt.LINES)
    got = re.alignment(sheet(spark), lines, spiral).where("turn = 0 and plane = 'xy'").collect()
    return got[0]["align_term"] if got else None


@pytest.mark.parametrize(
    "points, want",
    [
        ([(0, 0), (5, 0), (10, 0), (15, 0)], 0.0),  # on the path
        ([(0, 3), (5, 3), (10, 3), (15, 3)], 0.1 * (3 / 16 * 0.25 + 0.75) * 0.5),  # beside it
        ([(0, 0), (10, 0)], 0.1 * 0.5),  # a step without neighbours draws nothing
        ([(5, 0), (5, 10)], (10 * 1 + 0.1) * 0.5),  # across
        ([(200, 0), (205, 0), (210, 0)], None),  # no path around: no term
    ],
)
def test_alignment_of_a_quad_with_a_path(spark, points, want):
    got = term(spark, points)
    assert (got is None) == (want is None)
    assert want is None or np.isclose(got, want)


def test_steps_on_another_winding_draw_nothing(spark):
    points = [(0, 0), (5, 0), (10, 0), (15, 0)]
    fit = {"r0": [0.0, 0.0], "harmonics": [0, 0, 0, 0], "omega": 20.0}
    here, there = (fit, (-32.0, 0.0), 100.0), (fit, (-12.0, 0.0), 100.0)  # wind 2: a radius of 40
    assert np.isclose(term(spark, points, here), 0.0)
    assert np.isclose(term(spark, points, there), 0.1 * 0.5)


def test_nothing_in_nothing_out(spark):
    lines = spark.createDataFrame([], pt.LINES)
    assert re.alignment(sheet(spark), lines).isEmpty()
    assert re.alignment(sheet(spark).where("i = 0"), lines).isEmpty()
