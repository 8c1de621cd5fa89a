"""Queries that must do the whole job, not a part that is cheap to check."""

import random

import numpy as np

from lamina.functions.derive import surface_points, voxels
from lamina.operators import solve, stats
from lamina.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_median5_runs_over_the_whole_volume(spark):
    v = np.zeros((32, 32, 32), int)
    for r in voxels(spark, FOLDER).collect():
        v[r["z"], r["y"], r["x"]] = r["v"]
    around = np.lib.stride_tricks.sliding_window_view(np.pad(v, 2, mode="edge"), (5, 5, 5))
    want = np.median(around.reshape(32, 32, 32, 125), axis=-1)
    got = registry.queries()["w2_median5_whole"](spark, FOLDER).toPandas()
    assert len(got) == 32**3
    assert (want[got["z"], got["y"], got["x"]] == got["v"]).all()


def test_ranked_elements_of_keys_over_many_ranges(spark):
    rng = random.Random(5)
    values = [(k % 3 if k % 2 else 0, rng.randrange(200) / 4) for k in range(2000)]
    df = spark.createDataFrame([*values, (1, None)], "k int, v double")
    by = {k: sorted(v for a, v in values if a == k) for k in range(3)}
    for sql, at in (("n div 2", lambda n: n // 2), ("n - 1 - n div 20", lambda n: n - 1 - n // 20), ("n div 20", lambda n: n // 20)):
        assert dict(map(tuple, stats.ranked(df, ["k"], "v", sql).collect())) == {k: v[at(len(v))] for k, v in by.items()}
    every = sorted(v for _, v in values)
    assert stats.ranked(df, [], "v", "n div 2").first()["v"] == every[1000]


def test_donor_coverage_is_of_the_cells_there_are(spark):
    r = registry.queries()["a19_donor_agreement"](spark, "/root/testdata/sf0.01").first()
    assert r["n"] > 0 and r["coverage"] == r["n"] / 10_000


def test_every_segment_grows_until_nothing_is_new(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.queries()["i2_i3_surface_growth"](spark, folder).toPandas()
    assert set(got["seg_id"]) == {r["seg_id"] for r in surface_points(spark, folder).select("seg_id").distinct().collect()}
    full = got[got["seg_id"] < 4].groupby("seg_id")["gen"].max()
    assert len(full) == 4 and (full > 0).all()
    assert not got.duplicated(["seg_id", "j", "i"]).any()
    again = solve.grown(spark.createDataFrame(got).drop("gen"), surface_points(spark, folder).select("x", "y", "z"), 10, 50, 1, 20.0, 12.0)
    assert again.count() == len(got)
