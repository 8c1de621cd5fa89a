"""Segment store, TIFF surfaces, labels on disk, users' functions."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import hooks
from lamina.operators import index, solve
from lamina.sources import segments, volumes


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def tiff(a, deflate=False):
    body = a.astype("<f4").tobytes()
    body = zlib.compress(body) if deflate else body
    h, w = a.shape
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 8 if deflate else 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, len(body)), (339, 3, 1, 3)]
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)


@pytest.mark.parametrize("deflate", [False, True])
def test_tiff_surface(spark, tmp_path, deflate):
    d = tmp_path / "seg"
    d.mkdir()
    x, y = np.meshgrid(np.arange(4.0), np.arange(3.0))
    z = np.full((3, 4), 5.0)
    z[1, 2] = -1
    x[0, 0] = np.nan
    for n, a in (("x", x), ("y", y), ("z", z)):
        (d / f"{n}.tif").write_bytes(tiff(a, deflate))
    got = segments.tiff_surfaces(spark, f"file://{tmp_path}").collect()
    assert len(got) == 10 and all((r["x"], r["y"], r["z"]) == (r["i"], r["j"], 5.0) for r in got) and got[0]["name"] == "seg"
    with pytest.raises(ValueError):
        segments.tiff_plane(b"nothing of the kind")


def surface(spark, name, shift):
    return spark.createDataFrame([(name, j, i, 20.0 * i + shift, 20.0 * j, 5.0) for j in range(20) for i in range(20)], "name string, j int, i int, x double, y double, z double")


def test_store_keeps_others_and_replaces_names(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    segments.pack(spark, store, surface(spark, "a", 0.0).union(surface(spark, "b", 1000.0)))
    segments.pack(spark, store, surface(spark, "b", 5000.0))
    tiles = spark.read.parquet(f"{store}/tiles")
    assert [r["seg_id"] for r in index.near_query(tiles, (5100.0, 0.0, 5.0), 50.0, 5).collect()] == ["b"]
    assert [r["seg_id"] for r in index.near_query(tiles, (100.0, 0.0, 5.0), 50.0, 5).collect()] == ["a"]
    assert spark.read.parquet(f"{store}/points").count() == 800


def test_label_bricks(spark, tmp_path):
    path = f"file://{tmp_path}/lab"
    lab = spark.createDataFrame([(1, 1, 1, 3, 1), (9, 1, 1, 4, 2)], "z int, y int, x int, cls int, gen int")
    segments.save_labels(spark, lab, path, 0, 8)
    assert values(spark.read.parquet(path), "z", "cls") == [(1, 3), (9, 4)]
    later = spark.createDataFrame([(1, 1, 1, 5, 3), (9, 1, 1, 0, 4)], "z int, y int, x int, cls int, gen int")
    segments.save_labels(spark, later, path, 2, 8)
    assert values(spark.read.parquet(path), "z", "cls") == [(1, 5)]


def test_png_and_layers(spark):
    s = spark.createDataFrame([(0, 0, j, i, j * 4 + i) for j in range(3) for i in range(4)], "seg_id int, layer int, j int, i int, v int")
    data = bytes(segments.stack_layers(s, 3, 4).first()["data"])
    assert data.startswith(b"\x89PNG") and zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]) == b"".join(b"\0" + bytes(range(4 * j, 4 * j + 4)) for j in range(3))


def test_user_model_over_bricks(spark):
    v = spark.createDataFrame([(1, 2, 3, 200), (1, 2, 2, 90)], "z int, y int, x int, v int")
    out = segments.predicted_cells(volumes.bricks(v, 8), lambda a: a / 2, 8, 60)
    assert values(out, "z", "y", "x", "v") == [(1, 2, 3, 100)]


def test_hooks(spark):
    f = hooks.sampler(lambda z, y, x: z * 100 + y * 10 + x)
    assert spark.createDataFrame([(1, 2, 3)], "z int, y int, x int").select(f("z", "y", "x")).first()[0] == 123
    assert hooks.RawVoxels(F.lit(b"\x00\x05"), F.lit(1), F.lit(1), F.lit(2)).collect()[0] == (0, 0, 1, 5)
    assert hooks.side_by_side(spark, [lambda k=k: spark.range(k).count() for k in range(5)]) == [0, 1, 2, 3, 4]


def test_regrowth_fills_what_was_emptied(spark):
    targets = spark.createDataFrame([(float(x), float(y), 10.0) for x in range(0, 50, 5) for y in range(0, 50, 5)], "x double, y double, z double")
    cells = spark.createDataFrame([(0, j, i, 5.0 * i, 5.0 * j, 10.0) for j in range(8) for i in range(8)], "seg_id int, j int, i int, x double, y double, z double")
    out = solve.regrown(cells, cells.where("i = 4 and j = 4"), targets, 8, 8, 4, 5.0, 2.0)
    assert values(out, "j", "i", "x", "y") == values(cells, "j", "i", "x", "y")
    assert solve.shifted(cells, 2, 3).agg(F.min("j"), F.min("i")).first()[:] == (2, 3)


def test_populate_and_paths(spark):
    g = spark.createDataFrame([(0, 0, 0, 0.0, 1.0, 5.0)], "seg_id int, j int, i int, theta double, wind double, z double")
    fit = {"r0": [10.0, 20.0], "harmonics": [0, 0, 0, 0], "omega": 3.0}
    assert values(solve.populated(g, fit, (1.0, 2.0), 10.0), "x", "y", "z") == [(19.0, 2.0, 5.0)]
    lines = spark.createDataFrame([(1, 0.0, 0.0, 200.0, 0.0), (2, 500.0, 500.0, 510.0, 500.0)], "path_id int, x0 double, y0 double, x1 double, y1 double")
    assert values(solve.paths_near(lines, 150.0, 10.0, 20.0), "path_id") == [(1,)]
