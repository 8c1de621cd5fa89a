"""Block-wise stencils of odd shapes, components of links, and rules that have limits."""

import random

import numpy as np
import pytest

from lamina.operators import axis, quality, stencil
from lamina.operators.graph import least_of_component

SHAPE = (5, 18, 33)


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(2).integers(0, 256, SHAPE) * (np.random.default_rng(3).random(SHAPE) < 0.6)


def frame(spark, a):
    return spark.createDataFrame([(int(z), int(y), int(x), int(a[z, y, x])) for z, y, x in np.argwhere(a)], "z int, y int, x int, v int")


def array(df, column="v"):
    out = np.full(SHAPE, -1)
    for r in df.collect():
        assert out[r["z"], r["y"], r["x"]] == -1
        out[r["z"], r["y"], r["x"]] = r[column]
    return out


def test_medians_of_a_shape_that_no_block_divides(spark, cube):
    for r in (1, 2):
        around = np.lib.stride_tricks.sliding_window_view(np.pad(cube, r, mode="edge"), (2 * r + 1,) * 3).reshape(*SHAPE, -1)
        assert (array(stencil.median(frame(spark, cube), r, SHAPE)) == np.median(around, axis=-1)).all()


def test_distances_of_a_nearly_empty_volume(spark):
    solid = spark.createDataFrame([(1, 2, 3)], "z int, y int, x int")
    z, y, x = np.indices(SHAPE)
    want = np.minimum((z - 1) ** 2 + (y - 2) ** 2 + (x - 3) ** 2, 255)
    assert (array(stencil.distance_transform(solid, SHAPE), "d2") == want).all()
    assert (array(stencil.distance_transform(solid.where("z > 1"), SHAPE), "d2") == 255).all()


def test_components_of_random_links(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(400 + k, 401 + k) for k in range(50)] + [(600, 600 + k) for k in range(40)]
    parent = list(range(700))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = least_of_component(spark.createDataFrame(links, "u long, v long").repartition(6))
    assert {r["u"]: r["v"] for r in got.collect()} == {x: find(x) for x in range(700) if find(x) != x}
    assert least_of_component(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hysteresis_follows_a_winding_path(spark):
    path = [(0, 0, x) for x in range(30)] + [(0, 1, 29)] + [(0, 2, x) for x in range(29, -1, -1)]
    weak = spark.createDataFrame([*path, (4, 9, 9)], "z int, y int, x int")
    got = stencil.hysteresis(weak.where("x = 0 and y = 0"), weak, SHAPE)
    assert {tuple(r) for r in got.select("z", "y", "x").collect()} == set(path)


def test_edits_are_taken_back_up_to_a_limit(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "z int, x double, y double")
    edits = spark.createDataFrame([(k, 1 + k % 2, float(k), float(k)) for k in range(1, 101)], "seq long, z int, x double, y double")
    at = lambda n: {r["z"]: r["x"] for r in axis.undone(points, edits, n).collect()}
    assert at(0) == {1: 100.0, 2: 99.0} and at(1) == {1: 98.0, 2: 99.0} and at(64) == {1: 36.0, 2: 35.0}
    with pytest.raises(ValueError):
        axis.undone(points, edits, 65)


def test_candidates_come_in_order_of_support(spark):
    cells = [(0, j, i) for j in range(4) for i in range(4) if (j, i) not in ((1, 1), (3, 3))]
    df = spark.createDataFrame(cells, "seg_id int, j int, i int")
    got = quality.candidates(df, spark.createDataFrame([(0, 5, 5)], "seg_id int, h int, w int")).orderBy("by_support").collect()
    assert (got[0]["j"], got[0]["i"], got[0]["n8"], got[0]["score"]) == (1, 1, 8, 24)
    assert [r["n8"] for r in got] == sorted((r["n8"] for r in got), reverse=True)
    assert all(0 <= r["j"] < 5 and 0 <= r["i"] < 5 and (0, r["j"], r["i"]) not in cells for r in got)


def test_two_donors_vouch_for_a_cell(spark):
    rows = [(k, 0.9, 1.0, 0) for k in range(50)] + [(100, 0.9, 40.0, 0), (101, 0.9, -40.0, 2), (102, 0.1, 40.0, 1)]
    got = {r["pt_id"]: r["conf"] for r in quality.distrusted(spark.createDataFrame(rows, "pt_id int, conf double, residual double, donors int"), 10.0).collect()}
    assert got[0] == 0.9 and got[100] == 0.25 and got[101] == 0.9 and got[102] == 0.1


def test_a_segment_that_is_gone_has_a_stale_map(spark):
    sp = spark.createDataFrame([(0, j, i) for j in range(3) for i in range(4)], "seg_id int, j int, i int")
    maps = spark.createDataFrame([(0, 4, 3, 12), (1, 4, 3, 12), (0, 4, 3, 11)], "seg_id int, gw int, gh int, nvalid long")
    assert sorted((r["seg_id"], r["nvalid"]) for r in quality.stale_maps(maps, sp).collect()) == [(0, 11), (1, 12)]


def test_distances_over_several_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    shape = (70, 9, 66)
    solid = np.unique(np.stack([rng.integers(0, n, 60) for n in shape], 1), axis=0)
    got = stencil.distance_transform(spark.createDataFrame([tuple(map(int, p)) for p in solid], "z int, y int, x int"), shape).toPandas()
    at = got[["z", "y", "x"]].to_numpy()
    want = np.minimum(((at[:, None] - solid[None]) ** 2).sum(2).min(1), 255)
    assert len(got) == np.prod(shape) and (got["d2"].to_numpy() == want).all()
