"""Sources, sidecars, stored bricks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.sources import segments, sidecars, volumes


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_raw_volume(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes(3 * k for k in range(24)))
    v = volumes.raw_volume(spark, f"file://{tmp_path}/a.raw", (2, 3, 4))
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in v.collect()}
    assert got[1, 2, 3] == 69 and got[1, 0, 0] == 36 and (0, 0, 0) not in got
    with pytest.raises(Exception, match="expected"):
        volumes.raw_volume(spark, f"file://{tmp_path}/a.raw", (2, 3, 5)).count()


def test_crc32c():
    assert volumes.crc32c(b"123456789") == 0xE3069283


def test_shards(spark, tmp_path):
    a = np.arange(64).reshape(4, 4, 4).astype(np.uint8)
    good = volumes.shard_bytes({(0, 1, 0): volumes.encode_chunk(a)}, 2)
    (tmp_path / "good").write_bytes(good)
    (tmp_path / "bad").write_bytes(good[:-1] + bytes([good[-1] ^ 1]))
    c = volumes.shard_chunks(spark, f"file://{tmp_path}/good", 2)
    assert [r["count"] for r in c.groupBy("status").count().orderBy("status").collect()] == [7, 1]
    v = {(r["z"], r["y"], r["x"]): r["v"] for r in volumes.decoded_chunks(c, 4).collect()}
    assert v[3, 7, 3] == 63 and len(v) == 63
    assert [r["status"] for r in volumes.shard_chunks(spark, f"file://{tmp_path}/bad", 2).collect()] == ["corrupt"]


def test_mirror(spark, tmp_path):
    (tmp_path / "0.0.0").write_bytes(b"x" * 8)
    (tmp_path / "0.0.1.missing").write_bytes(b"")
    got = {(r["cz"], r["cy"], r["cx"]): r["status"] for r in volumes.mirror_status(spark, f"file://{tmp_path}", (1, 1, 3)).collect()}
    assert got == {(0, 0, 0): "data", (0, 0, 1): "absent", (0, 0, 2): "pending"}


def test_stored_bricks_read_back_by_box(spark, tmp_path):
    spark.dataSource.register(volumes.SyntheticVolume)
    v = spark.read.format("lamina_synthetic").options(kind="shells", size=24).load()
    volumes.write_bricks(volumes.bricks(v, 8), f"file://{tmp_path}/l0")
    got = volumes.read_box(spark, f"file://{tmp_path}/l0", (3, 4, 5), (11, 20, 17), 8)
    from lamina.operators.volume import box

    assert values(got, "z", "y", "x", "v") == values(box(v, (3, 4, 5), (11, 20, 17)), "z", "y", "x", "v")


@pytest.mark.parametrize("kind", ["sphere", "shells", "gyroid"])
def test_synthetic(spark, kind):
    spark.dataSource.register(volumes.SyntheticVolume)
    v = spark.read.format("lamina_synthetic").options(kind=kind, size=16).load()
    assert v.count() and v.agg({"v": "max"}).first()[0] <= 255


def test_assembly_lists_missing_bricks(spark):
    n = spark.createDataFrame([("z0_y0_x0",), ("z1_y0_x1",), ("junk",)], "name string")
    assert values(volumes.incomplete(n), "bz", "by", "bx") == [(0, 0, 1), (1, 0, 0)]
    assert volumes.brick_name("z012_y003_x004.c5b") == (12, 3, 4)


@pytest.mark.parametrize("body", [{"control_points": [{"x": 1, "y": 2, "z": 3}, {"x": 4, "y": 5, "z": 1}]}, {"points": [[3, 2, 1], [1, 5, 4]]}, [{"x": 1.0, "y": 2.0, "z": 3.0}, {"x": 4, "y": 5, "z": 1}], [[3, 2, 1], [1, 5, 4]]])
def test_axis_json(spark, body):
    text = spark.createDataFrame([(json.dumps(body),)], "value string")
    axis = sidecars.axis_points(text)
    assert values(axis, "z", "x", "y") == [(1.0, 4.0, 5.0), (3.0, 1.0, 2.0)]
    assert values(sidecars.axis_points(sidecars.axis_json(axis)), "z", "x", "y") == values(axis, "z", "x", "y")


def test_transform_json(spark):
    m = [[2.0, 0, 0, 1], [0, 4.0, 0, 2], [0, 0, 1.0, 3]]
    assert sidecars.pull_matrix(sidecars.transform_json(spark, m)) == m
    published = spark.createDataFrame([(json.dumps({"transformation_matrix": m}),)], "value string")
    assert np.allclose(sidecars.pull_matrix(published), [[0.5, 0, 0, -0.5], [0, 0.25, 0, -0.5], [0, 0, 1, -3]])
    with pytest.raises(ValueError):
        sidecars.pull_matrix(spark.createDataFrame([("{}",)], "value string"))


def test_manifest_and_seeds(spark, tmp_path):
    text = spark.createDataFrame([(json.dumps({"levels": [{"level": 0, "shape": [8, 8, 8]}, {"level": 1, "shape": [4, 4, 4]}, {"level": 9, "shape": [1, 1, 1]}]}),)], "value string")
    assert values(sidecars.level_table(text), "level", "scale", "nz") == [(0, 1, 8), (1, 2, 4)]
    for body in ([[1, 2, 3]], {"seeds": [[1, 2, 3]]}):
        assert values(sidecars.seeds(spark.createDataFrame([(json.dumps(body),)], "value string")), "x", "y", "z") == [(1.0, 2.0, 3.0)]
    (tmp_path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [8, 8, 8], "chunks": [4, 4, 4], "dtype": "|u1", "fill_value": 0, "order": "C"}))
    assert sidecars.zarr_levels(sidecars.small_file(spark, f"file://{tmp_path}/.zarray")).first()["chunks"] == [4, 4, 4]


PAGE = "<ListBucketResult>{0}<Contents><Key>a/{1}</Key><Size>5</Size></Contents><CommonPrefixes><Prefix>a/sub/</Prefix></CommonPrefixes></ListBucketResult>"


def test_listing(spark):
    pages = {None: (200, PAGE.format("<IsTruncated>true</IsTruncated><NextContinuationToken>t</NextContinuationToken>", "one.json")), "t": (200, PAGE.format("", "bad name"))}
    assert values(sidecars.fetch_listing(spark, pages.get), "kind", "name") == [("object", "one.json"), ("prefix", "sub")]
    for page in ((500, ""), (200, "<html>"), (200, PAGE.format("<IsTruncated>true</IsTruncated><NextContinuationToken>t</NextContinuationToken>", "x"))):
        with pytest.raises(OSError):
            sidecars.fetch_listing(spark, lambda token, page=page: page)


def test_a_raw_file_is_read_by_ranges(spark, tmp_path, monkeypatch):
    """Many records of some rows each, planes without a voxel between them."""
    monkeypatch.setattr(volumes, "RECORD_BYTES", 20)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (6, 8, 10), dtype=np.uint8)
    a[2] = 0
    v = spark.createDataFrame([(int(z), int(y), int(x), int(a[z, y, x])) for z, y, x in np.argwhere(a)], "z int, y int, x int, v int")
    volumes.write_raw(v, f"file://{tmp_path}/w/v.raw", a.shape)
    assert (tmp_path / "w/v.raw").read_bytes() == a.tobytes()
    assert values(volumes.raw_volume(spark, f"file://{tmp_path}/w/v.raw", a.shape), "z", "y", "x", "v") == values(v, "z", "y", "x", "v")


def test_shard_entries_beyond_the_file_are_corrupt(spark, tmp_path):
    import struct

    data = bytearray(volumes.shard_bytes({(0, 0, 0): b"abc", (1, 1, 1): b"defg"}, 2))
    data[7:23] = struct.pack("<QQ", 5, 1000)
    data[-4:] = struct.pack("<I", volumes.crc32c(bytes(data[7:-4])))
    (tmp_path / "x.shard").write_bytes(data)
    (tmp_path / "tiny.shard").write_bytes(b"no index")
    got = {(r["file"].rpartition("/")[2], r["cz"], r["cy"], r["cx"]): (r["status"], r["data"] and bytes(r["data"])) for r in volumes.shard_chunks(spark, f"file://{tmp_path}", 2).collect()}
    assert got["x.shard", 0, 0, 0] == ("corrupt", None) and got["x.shard", 1, 1, 1] == ("present", b"defg") and got["x.shard", 0, 1, 0] == ("missing", None)
    assert got["tiny.shard", None, None, None] == ("corrupt", None) and len(got) == 9


def test_labels_of_another_volume_are_an_error(spark, tmp_path):
    from lamina.sources import segments

    segments.save_labels(spark, spark.createDataFrame([(1, 1, 9, 3, 1)], "z int, y int, x int, cls int, gen int"), f"file://{tmp_path}/lab", 0, 8)
    assert segments.load_labels(spark, f"file://{tmp_path}/lab", (2, 2, 10)).count() == 1
    with pytest.raises(Exception, match="don't fit"):
        segments.load_labels(spark, f"file://{tmp_path}/lab", (2, 2, 9)).collect()


def test_crc_of_long_inputs_is_that_of_the_plain_loop():
    rng = np.random.default_rng(6)
    for n in (16 * volumes.LANES - 1, 16 * volumes.LANES, 17 * volumes.LANES + 5, 200_001):
        data, c = rng.integers(0, 256, n, np.uint8).tobytes(), 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        assert volumes.crc32c(data) == c ^ 0xFFFFFFFF


def test_shards_are_streamed_chunk_by_chunk(spark, tmp_path, monkeypatch):
    """Several shards, some of their chunks missing, in batches of one chunk: all voxels come back, and the setting of batches is as before."""
    monkeypatch.setattr(volumes, "CHUNK_BATCH", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = np.random.default_rng(7)
    at = np.unique(rng.integers(0, 24, (300, 3)), axis=0)
    rows = [(*map(int, p), int(v)) for p, v in zip(at, rng.integers(1, 256, len(at)), strict=True)]
    volumes.write_shards(spark.createDataFrame(rows, "z int, y int, x int, v int").repartition(5), f"file://{tmp_path}", 4, 2)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    chunks = volumes.shard_chunks(spark, f"file://{tmp_path}", 2)
    names = {(z // 8, y // 8, x // 8) for z, y, x, _ in rows}
    assert chunks.count() == 8 * len(names) and {r["status"] for r in chunks.select("status").distinct().collect()} == {"present", "missing"}
    part = lambda c: F.regexp_extract("file", rf"{c}([0-9]+)[_.]", 1).cast("int")
    back = volumes.decoded_chunks(chunks.select(*((part(c) * 2 + F.col("c" + c)).alias("c" + c) for c in "zyx"), "status", "data"), 4)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_a_crash_between_two_renames_loses_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    segments.publish(spark.range(3), path)
    segments.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "table.old").exists()
    (tmp_path / "table").rename(tmp_path / "table.old")  # as after a crash
    segments.recover(spark, path)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "table").rename(tmp_path / "table.old")
    segments.publish(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and not (tmp_path / "table.old").exists()
