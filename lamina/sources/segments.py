"""The segment store: surfaces and their tile index as Parquet, surfaces from TIFF planes, and outputs published whole."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import surface as su
from lamina.session import saved
from lamina.sources.files import write_files


def tiff_plane(data: bytes) -> np.ndarray:
    """A single-plane float32 TIFF, stored plain or deflated in strips."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            size = n * struct.calcsize(code)
            raw = entry[8 : 8 + size] if size <= 4 else data[(o := struct.unpack(order + "I", entry[8:])[0]) : o + size]
            tags[tag] = struct.unpack(f"{order}{n}{code}", raw)
    w, h = tags[256][0], tags[257][0]
    if tags.get(258, (1,))[0] != 32 or tags.get(339, (1,))[0] != 3 or tags.get(277, (1,))[0] != 1:
        raise ValueError("not a plane of 32-bit floats")
    how = tags.get(259, (1,))[0]
    if how not in (1, 8, 32946):
        raise ValueError(f"compression {how} isn't supported")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    body = b"".join(strips if how == 1 else map(zlib.decompress, strips))
    return np.frombuffer(body, order + "f4", w * h).reshape(h, w).astype(np.float32)


def tiff_bytes(a: np.ndarray) -> bytes:
    """A plane of float32 as a TIFF of one strip."""
    h, w = a.shape
    body = np.ascontiguousarray(a, "<f4").tobytes()
    tags = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body)), (339, 3, 3)]
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, kind, 1, x) for t, kind, x in tags) + struct.pack("<I", 0)


def write_tiff_surfaces(sp: DataFrame, path: str) -> None:
    """Surfaces ``(name, j, i, x, y, z)`` as folders with x.tif, y.tif and z.tif; a cell without a point has z = -1. A surface's planes are made by one task."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        shape = int(g["j"].max()) + 1, int(g["i"].max()) + 1
        out = []
        for c in "xyz":
            a = np.full(shape, -1, np.float32)
            a[g["j"], g["i"]] = g[c]
            out.append((f"{key[0]}/{c}.tif", tiff_bytes(a)))
        return pd.DataFrame(out, columns=["name", "data"])

    write_files(sp.groupBy(F.col("name").alias("_name")).applyInPandas(run, "name string, data binary"), path)


def tiff_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """``(name, j, i, x, y, z)`` of the valid points of surfaces in folders under ``path`` with x.tif, y.tif and z.tif; points are valid where z > 0 and x, y are finite."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[xyz].tif").load(path)
    planes = files.select(F.regexp_extract("path", r"([^/]+)/[xyz]\.tif$", 1).alias("name"), F.regexp_extract("path", r"([xyz])\.tif$", 1).alias("axis"), "content")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p = {a: tiff_plane(c) for a, c in zip(g["axis"], g["content"], strict=True)}
        if set(p) != {"x", "y", "z"} or len({a.shape for a in p.values()}) != 1:
            raise ValueError(f"{key[0]} hasn't three planes of one size")
        ok = (p["z"] > 0) & np.isfinite(p["x"]) & np.isfinite(p["y"]) & np.isfinite(p["z"])
        j, i = np.nonzero(ok)
        return pd.DataFrame({"name": key[0], "j": j.astype(np.int32), "i": i.astype(np.int32)} | {a: p[a][ok] for a in "xyz"})

    return planes.groupBy("name").applyInPandas(run, "name string, j int, i int, x float, y float, z float")


def pack(spark: SparkSession, store: str, new: DataFrame, tile: int = 16) -> None:
    """Adds surfaces ``new(name, j, i, x, y, z)`` to a store, replacing those of the same names; the others' rows are kept.

    The store is the tables points and tiles under one folder; both are written beside the old ones
    first and then take their place.
    """
    sp = new.select(F.col("name").alias("seg_id"), "j", "i", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    points, index = sp, su.tile_boxes(su.tiles(sp, tile), su.bounds(sp))
    for part in ("points", "tiles"):
        recover(spark, f"{store}/{part}")
    if _there(spark, f"{store}/points"):
        names = sp.select("seg_id").distinct()
        points = spark.read.parquet(f"{store}/points").join(names, "seg_id", "left_anti").unionByName(points)
        index = spark.read.parquet(f"{store}/tiles").join(names, "seg_id", "left_anti").unionByName(index)
    publish(points, f"{store}/points")
    publish(index, f"{store}/tiles")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def recover(spark: SparkSession, path: str) -> None:
    """Puts the old table back where a crash came between its moving aside and the new one's taking its place."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath(path)) and fs.exists(jpath(f"{path}.old")) and not fs.rename(jpath(f"{path}.old"), jpath(path)):
        raise OSError(f"{path}.old couldn't be renamed")


def publish(df: DataFrame, path: str) -> None:
    """Writes a table to a new folder beside ``path``, moves the old table aside, puts the new one in its place and only then removes the old one.

    There is a whole table at any time, at ``path`` or at ``path``.old, from where ``recover`` puts it back.
    """
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    staged, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    recover(spark, path)
    df.write.parquet(staged)
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath(path)):
        if fs.exists(jpath(old)):
            fs.delete(jpath(old), True)
        if not fs.rename(jpath(path), jpath(old)):
            raise OSError(f"{path} couldn't be renamed")
    if not fs.rename(jpath(staged), jpath(path)):
        raise OSError(f"{staged} couldn't be renamed")
    if fs.exists(jpath(old)):
        fs.delete(jpath(old), True)


def save_labels(spark: SparkSession, lab: DataFrame, path: str, saved_gen: int, brick: int = 128) -> None:
    """Writes the bricks of labels (with a column ``gen``) edited after ``saved_gen``; others' files aren't touched, and bricks left empty become empty files."""
    from lamina.operators.labels import dirty
    from lamina.operators.volume import ZYX

    keys = [F.expr(f"cast({c} div {brick} as int)").alias("b" + c) for c in ZYX]
    todo = saved(dirty(lab, saved_gen, brick).select(*(F.col(c).alias("b" + c) for c in ZYX)))
    rows = lab.select("*", *keys).join(todo, ["bz", "by", "bx"]).where("cls > 0 and cls < 9")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bz", "by", "bx").parquet(path)
    gone = todo.join(rows.select("bz", "by", "bx").distinct(), ["bz", "by", "bx"], "left_anti")
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    for r in gone.toLocalIterator():
        p = jpath(f"{path}/bz={r['bz']}/by={r['by']}/bx={r['bx']}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def load_labels(spark: SparkSession, path: str, shape) -> DataFrame:
    """``lab(z, y, x, cls)`` of saved label bricks; a voxel outside ``shape`` means the labels are of another volume, an error."""
    from lamina.operators.volume import ZYX

    lab = spark.read.parquet(path).select(*ZYX, "cls")
    outside = F.lit(False)
    for c, n in zip(ZYX, shape, strict=True):
        outside = outside | (F.col(c) < 0) | (F.col(c) >= n)
    checked = F.when(outside, F.raise_error(F.lit("the labels don't fit the volume"))).otherwise(F.col("cls"))
    return lab.select(*ZYX, checked.cast("int").alias("cls"))


def save_trace(cells: DataFrame, path: str, cutoff: float, step: float) -> None:
    """Publishes a traced surface (seg_id, j, i, x, y, z, conf): cells above the confidence ``cutoff`` without those at a torn edge, on a grid cropped
    to what is left; ``j0`` and ``i0`` are the cropped grid's first row and column in the old one."""
    sure = cells.where(F.col("conf") > cutoff)
    kept = sure.join(su.untorn(sure, step).select(*su.CELL), list(su.CELL), "left_semi")
    first = kept.groupBy("seg_id").agg(F.min("j").alias("j0"), F.min("i").alias("i0"))
    out = kept.join(first, "seg_id").select("seg_id", (F.col("j") - F.col("j0")).cast("int").alias("j"), (F.col("i") - F.col("i0")).cast("int").alias("i"), *"xyz", "conf", "j0", "i0")
    publish(out, path)


def png_gray(a: np.ndarray) -> bytes:
    """An 8-bit grey PNG of a small image."""
    h, w = a.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(a, np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit grey PNG as ``png_gray`` writes it."""
    w, h = struct.unpack(">II", data[16:24])
    size = struct.unpack(">I", data[33:37])[0]
    return np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(h, w + 1)[:, 1:]


def write_layers(images: DataFrame, path: str) -> None:
    """Images ``(seg_id, layer, data)`` as files seg_id/layer.png."""
    write_files(images.select(F.concat_ws("/", "seg_id", F.format_string("%05d.png", "layer")).alias("name"), "data"), path)


def layer_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``(seg_id, layer, j, i, v)`` of the images under ``path``, zeros left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seg, layer, data in zip(b["seg_id"], b["layer"], b["content"], strict=True):
                a = png_pixels(data)
                j, i = np.nonzero(a)
                yield pd.DataFrame({"seg_id": seg, "layer": layer, "j": j, "i": i, "v": a[j, i]}).astype("int32")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    own = files.select(F.regexp_extract("path", r"([0-9]+)/[0-9]+\.png$", 1).cast("int").alias("seg_id"), F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("int").alias("layer"), "content")
    return own.mapInPandas(run, "seg_id int, layer int, j int, i int, v int")


def stack_layers(stack: DataFrame, height: int, width: int) -> DataFrame:
    """``(seg_id, layer, data)``: each layer of a stack (seg_id, layer, j, i, v) as an image's bytes; a layer is one task."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width), np.uint8)
        a[g["j"], g["i"]] = g["v"]
        return pd.DataFrame([(*key, png_gray(a))], columns=["seg_id", "layer", "data"])

    return stack.groupBy("seg_id", "layer").applyInPandas(run, "seg_id int, layer int, data binary")


def predicted_cells(bricks: DataFrame, model, edge: int, threshold: int) -> DataFrame:
    """Predictions of a user's ``model`` (a function of a float array edge cubed in 0..1) over bricks (bz, by, bx, data), cut at a threshold of 255ths; voxels of the result.

    The model travels to the workers with the function; batches of bricks go through it one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bz, by, bx, data in zip(b["bz"], b["by"], b["bx"], b["data"], strict=True):
                v = np.frombuffer(zlib.decompress(data), np.uint8).reshape((edge,) * 3) / 255
                p = np.floor(np.clip(model(v), 0, 1) * 255).astype(int)
                z, y, x = np.nonzero(p >= max(1, threshold))
                yield pd.DataFrame({"z": z + bz * edge, "y": y + by * edge, "x": x + bx * edge, "v": p[z, y, x]}).astype("int32")

    return bricks.select("bz", "by", "bx", "data").mapInPandas(run, "z int, y int, x int, v int")
