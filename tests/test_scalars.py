"""Scalar functions against known values and plain Python."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from lamina.functions import scalars


def test_hashes_of_names_and_pixels(spark):
    def plain(b):
        h = scalars.FNV_START
        for x in b:
            h = (h ^ x) * 1099511628211 % 2**64
        return f"{h:016x}"

    def pixel(x, y, f):
        h = (x * 374761393 + y * 668265263 + f * 2246822519) % 2**32
        h = (h ^ (h >> 13)) * 1274126177 % 2**32
        return (h >> 8) / 2**24

    names = ["", "a", "segment-12", "ß中\x00", "x" * 3000]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", scalars.fnv1a64(F.col("n")).alias("h")).collect()
    assert {r["n"]: r["h"] for r in got} == {n: plain(n.encode()) for n in names}
    places = [(0, 0, 0), (1, 2, 3), (2**32 - 1, 2**31, 2**32 - 1), (1920, 1080, 100000)]
    got = spark.createDataFrame(places, "x long, y long, f long").select("x", "y", "f", scalars.pixel_hash(F.col("x"), F.col("y"), F.col("f")).alias("h")).collect()
    assert all(r["h"] == pixel(r["x"], r["y"], r["f"]) for r in got)


def test_names_and_freshness(spark):
    paths = {"a/b": "b", "a/b//": "b", "b": "b", "/": None, "": None, "a/" + "n" * 255: "n" * 255, "a/" + "n" * 256: None}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scalars.basename(F.col("p")).alias("b")).collect()
    assert {r["p"]: r["b"] for r in got} == paths
    rows = [(1, 5, 5, True), (1, 5, 6, False), (0, 5, 1, False), (1, 5, None, True), (None, 5, 1, False), (1, None, 1, False)]
    got = spark.createDataFrame(rows, "size int, m int, s int, want boolean").select("want", scalars.fresh(F.col("size"), F.col("m"), F.col("s")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    at = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    runs = spark.createDataFrame([(1, at), (2, at), (3, at + dt.timedelta(seconds=1))], "k int, t timestamp")
    assert [r["finish_name"] for r in scalars.finish_names(runs, "t", "k").orderBy("k").collect()] == ["20260102030405", "20260102030405-2", "20260102030406"]


def test_damped_step(spark):
    rng = np.random.default_rng(3)
    j = rng.normal(size=(5, 3))
    a, b = j.T @ j, rng.normal(size=3)
    d = scalars.damped_step([F.lit(float(a[p, q])) for p in range(3) for q in range(p, 3)], [F.lit(float(x)) for x in b], 0.1)
    got = spark.range(1).select(*(c.alias(n) for c, n in zip(d, "xyz", strict=True))).first()
    assert np.allclose(got, np.linalg.solve(a + 0.1 * np.diag(np.diag(a)), -b))
    zero = scalars.damped_step([F.lit(0.0)] * 6, [F.lit(1.0)] * 3, 0.0)
    assert spark.range(1).select(*zero).first()[:] == (None, None, None)
