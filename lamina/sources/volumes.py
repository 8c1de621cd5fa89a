"""Volumes and their parts as DataFrames. Files are read by Spark, so any store it can open will do.

A raw volume is one byte a voxel, x fastest. A shard is a file of chunks with an index at its end:
for each chunk of ``side`` cubed, in z, y, x order, its offset and length as little-endian 64-bit
numbers (both all ones: missing), and the CRC-32C of the index. A zarr mirror is a folder of raw
chunk files named z.y.x, with a file z.y.x.missing where the chunk is known to be absent.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina.operators.volume import ZYX
from lamina.session import saved
from lamina.sources.files import write_files

MISSING = (1 << 64) - 1
#: Bytes of a record of a raw file, at most, where a row has fewer.
RECORD_BYTES = 1 << 20


def raw_volume(spark: SparkSession, path: str, shape: Sequence[int]) -> DataFrame:
    """``voxel(z, y, x, v)`` of a raw file, zeros left out; an error if its size isn't that of the shape.

    The file is read as records of some rows each, by ranges of bytes, so that many tasks share it.
    """
    nz, ny, nx = shape
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    if size != nz * ny * nx:
        raise ValueError(f"{path} has {size} bytes where {nz * ny * nx} are expected")
    rows = max(r for r in range(1, ny + 1) if ny % r == 0 and (r == 1 or r * nx <= RECORD_BYTES))
    form = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(path, form, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{form}.recordLength": str(rows * nx)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b["k"], b["data"], strict=True):
                v = np.frombuffer(data, np.uint8)
                at = np.flatnonzero(v)
                p = at + int(k) * rows * nx
                yield pd.DataFrame({"z": p // (ny * nx), "y": p // nx % ny, "x": p % nx, "v": v[at]}).astype("int32")

    return spark.createDataFrame(records, "k long, data binary").mapInPandas(run, "z int, y int, x int, v int")


def planes(v: DataFrame, shape: Sequence[int]) -> DataFrame:
    """``(z, data)``: the bytes of every plane of a volume, planes without a voxel too."""
    nz, ny, nx = shape

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((ny, nx), np.uint8)
        g = g[g["v"] > 0]
        a[g["y"], g["x"]] = g["v"]
        return pd.DataFrame([(key[0], a.tobytes())], columns=["z", "data"])

    every = v.sparkSession.range(nz).select(F.col("id").cast("int").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0).alias("v"))
    return v.select(*ZYX, "v").union(every).groupBy("z").applyInPandas(run, "z int, data binary")


def write_raw(v: DataFrame, path: str, shape: Sequence[int]) -> None:
    """A volume as one flat file. Planes are made by many tasks; one appends them in order, a plane at a time, as a file has one writer."""
    folder, _, name = path.rpartition("/")
    write_files(planes(v, shape).repartition(1).sortWithinPartitions("z").select(F.lit(name).alias("name"), "data"), folder)


@functools.cache
def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0x82F63B78), out >> 1)
    return out


def _mapped(images: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers under a linear map, given by the images of single bits."""
    out = np.zeros_like(register)
    for bit in range(32):
        out ^= np.where(register >> np.uint32(bit) & np.uint32(1), images[bit], np.uint32(0))
    return out


@functools.cache
def _zeros(n: int) -> np.ndarray:
    """What ``n`` zero bytes do to a register, as images of single bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out, square = bits, _crc_table()[bits & np.uint32(255)] ^ bits >> np.uint32(8)
    while n:
        out = _mapped(square, out) if n & 1 else out
        square, n = _mapped(square, square), n >> 1
    return out


#: Parts that a long input is cut into; their checks are made side by side and then combined.
LANES = 1024


def crc32c(data: bytes) -> int:
    """CRC-32 with the Castagnoli polynomial."""
    table, every = _crc_table(), np.frombuffer(data, np.uint8)
    width = len(every) // LANES
    c = np.uint32(0xFFFFFFFF)
    if width >= 16:
        lanes = np.ascontiguousarray(every[: LANES * width].reshape(LANES, width).T)
        registers = np.zeros(LANES, np.uint32)
        registers[0] = c
        for column in lanes:
            registers = table[(registers ^ column) & np.uint32(255)] ^ registers >> np.uint32(8)
        step, count = width, LANES
        while count > 1:  # neighbours are joined: the left one goes over the right one's bytes
            registers = _mapped(_zeros(step), registers[0::2]) ^ registers[1::2]
            step, count = 2 * step, count // 2
        c, every = registers[0], every[LANES * width :]
    c, plain = int(c), table.tolist()
    for b in every.tolist():
        c = plain[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def shard_index(places: np.ndarray) -> bytes:
    """The end of a shard file: where each chunk is and how long (rows of two, ``MISSING`` where there is none), and the check of that."""
    table = places.astype("<u8").tobytes()
    return table + struct.pack("<I", crc32c(table))


def shard_bytes(chunks: dict[tuple[int, int, int], bytes], side: int) -> bytes:
    """A small shard file of the given chunk payloads."""
    places, body, at = np.full((side**3, 2), MISSING, np.uint64), [], 0
    for (z, y, x), data in sorted(chunks.items()):
        places[(z * side + y) * side + x] = at, len(data)
        body.append(data)
        at += len(data)
    return b"".join(body) + shard_index(places)


#: Bytes of voxels in a batch of chunks.
CHUNK_BATCH = 64 << 20


def write_shards(v: DataFrame, path: str, edge: int, side: int) -> None:
    """Shard files z*_y*_x*.shard of a volume's chunks of ``edge`` cubed, ``side`` cubed chunks a shard; chunks without a voxel are missing, shards without any aren't written.

    A chunk's voxels come together, never a shard's: chunks are sorted by shard and number, go to the
    file as they come, and only their places are held until the shard's index ends it.
    """

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((edge,) * 3, np.uint8)
        a[g["z"] % edge, g["y"] % edge, g["x"] % edge] = g["v"]
        return pd.DataFrame([("z{}_y{}_x{}.shard".format(*key[:3]), (key[3] * side + key[4]) * side + key[5], encode_chunk(a))], columns=["name", "k", "data"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, places = None, 0, np.full((side**3, 2), MISSING, np.uint64)
        batch = lambda names, parts: pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "data": pa.array(parts, pa.binary())})
        for b in batches:
            for own, k, data in zip(b.column("name").to_pylist(), b.column("k").to_pylist(), b.column("data"), strict=True):
                if own != name:
                    if name is not None:
                        yield batch([name], [shard_index(places)])
                    name, at = own, 0
                    places[:] = MISSING
                data = data.as_py()
                places[k] = at, len(data)
                at += len(data)
                yield batch([own], [data])
        if name is not None:
            yield batch([name], [shard_index(places)])

    spark, conf = v.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    keys = [F.expr(f"cast({c} div {edge * side} as int)").alias("s" + c) for c in ZYX]
    own = [F.expr(f"cast({c} div {edge} % {side} as int)").alias("c" + c) for c in ZYX]
    chunks = v.where("v > 0").select(*ZYX, "v", *keys, *own).groupBy("sz", "sy", "sx", "cz", "cy", "cx").applyInPandas(one, "name string, k int, data binary")
    chunks = saved(chunks)  # so that the sort moves payloads, and a voxel is read once
    usual = spark.conf.get(conf)
    spark.conf.set(conf, max(1, min(int(usual) or 10_000, CHUNK_BATCH // edge**3)))
    try:
        write_files(chunks.repartition("name").sortWithinPartitions("name", "k").mapInArrow(stream, "name string, data binary"), path)
    finally:
        spark.conf.set(conf, usual)


class ShardSource(DataSource):
    """Shard files by byte ranges: the index of a shard first, then each chunk's bytes; a shard is a partition."""

    @classmethod
    def name(cls) -> str:
        return "lamina_shards"

    def schema(self) -> str:
        return "file string, cz int, cy int, cx int, status string, data binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ShardReader(self.options["path"], int(self.options["side"]))


class _ShardReader(DataSourceReader):
    def __init__(self, path: str, side: int) -> None:
        self.path, self.side = path, side

    def partitions(self) -> list[InputPartition]:
        store, root = stores.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == stores.FileType.File:
            return [InputPartition(root)]
        return [InputPartition(f.path) for f in store.get_file_info(stores.FileSelector(root)) if f.type == stores.FileType.File and f.base_name[0] not in "._"]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = stores.FileSystem.from_uri(self.path)
        name, side, size = partition.value, self.side, 16 * self.side**3
        with store.open_input_file(name) as f:
            room = f.size() - size - 4
            tail = f.read_at(size + 4, room) if room >= 0 else b""
            if room < 0 or crc32c(tail[:-4]) != struct.unpack("<I", tail[-4:])[0]:
                yield name, None, None, None, "corrupt", None
                return
            for k, (at, n) in enumerate(struct.iter_unpack("<QQ", tail[:-4])):
                key = (name, k // (side * side), k // side % side, k % side)
                if at == n == MISSING:
                    yield *key, "missing", None
                elif at + n > room:
                    yield *key, "corrupt", None
                else:
                    yield *key, "present", f.read_at(n, at)


def shard_chunks(spark: SparkSession, path: str, side: int) -> DataFrame:
    """``chunk(file, cz, cy, cx, status, data)`` of shard files: present, missing or corrupt chunks; a file whose index fails its check is one corrupt row."""
    spark.dataSource.register(ShardSource)
    return spark.read.format("lamina_shards").option("side", side).load(path)


def encode_chunk(values: np.ndarray) -> bytes:
    """Payload of a chunk: its bytes in z, y, x order, deflated."""
    return zlib.compress(np.ascontiguousarray(values, np.uint8).tobytes())


def decoded_chunks(chunks: DataFrame, edge: int) -> DataFrame:
    """Voxels of present chunks, zeros left out; a payload that doesn't decode to edge cubed bytes is an error, never zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cz, cy, cx, data in zip(b["cz"], b["cy"], b["cx"], b["data"], strict=True):
                v = np.frombuffer(zlib.decompress(data), np.uint8).reshape((edge,) * 3)
                z, y, x = np.nonzero(v)
                yield pd.DataFrame({"z": z + cz * edge, "y": y + cy * edge, "x": x + cx * edge, "v": v[z, y, x]}).astype("int32")

    return chunks.where("status = 'present'").select("cz", "cy", "cx", "data").mapInPandas(run, "z int, y int, x int, v int")


def mirror_status(spark: SparkSession, path: str, grid: Sequence[int]) -> DataFrame:
    """``(cz, cy, cx, status, data)`` of every chunk of a mirror's grid: data, absent (known not to be there) or pending (not fetched yet)."""
    key = lambda c: [F.regexp_extract(c, r"(\d+)\.(\d+)\.(\d+)(\.missing)?$", k).try_cast("int").alias(n) for k, n in ((1, "cz"), (2, "cy"), (3, "cx"))]
    files = spark.read.format("binaryFile").load(path).where(~F.col("path").endswith(".missing"))
    files = files.select(*key("path"), F.struct("content").alias("c"), F.lit(False).alias("gone"))
    markers = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.missing")  # Spark's readers pass over empty files
    names = [(str(m.getPath().getName()),) for m in markers.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(markers) or []]
    gone = spark.createDataFrame(names, "name string").select(*key("name"), F.lit(None).cast(files.schema["c"].dataType).alias("c"), F.lit(True).alias("gone"))
    there = files.union(gone).where("cz is not null").groupBy("cz", "cy", "cx").agg(F.max("c").alias("c"), F.max("gone").alias("gone"))
    nz, ny, nx = grid
    every = spark.range(nz * ny * nx).select(F.expr(f"cast(id div {ny * nx} as int)").alias("cz"), F.expr(f"cast(id div {nx} % {ny} as int)").alias("cy"), F.expr(f"cast(id % {nx} as int)").alias("cx"))
    status = F.when(F.col("c").isNotNull(), "data").when(F.coalesce("gone", F.lit(False)), "absent").otherwise("pending")
    return every.join(there, ["cz", "cy", "cx"], "left").select("cz", "cy", "cx", status.alias("status"), F.col("c.content").alias("data"))


def bricks(v: DataFrame, edge: int = 128) -> DataFrame:
    """Stored form: one row a brick with its value range, count and deflated bytes; made brick by brick."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((edge,) * 3, np.uint8)
        a[g["z"] % edge, g["y"] % edge, g["x"] % edge] = g["v"]
        return pd.DataFrame([(*key, int(g["v"].min()), int(g["v"].max()), int((g["v"] > 0).sum()), encode_chunk(a))], columns=["bz", "by", "bx", "vmin", "vmax", "n_nonzero", "data"])

    return v.groupBy(*(F.expr(f"cast({c} div {edge} as int)").alias("b" + c) for c in ZYX)).applyInPandas(run, "bz int, by int, bx int, vmin int, vmax int, n_nonzero long, data binary")


def write_bricks(b: DataFrame, path: str) -> None:
    """Bricks of a level, partitioned by shard; only the shards written are replaced."""
    shard = [F.expr(f"cast(b{c} div 8 as int)").alias("s" + c) for c in ZYX]
    b.select("*", *shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sz", "sy", "sx").parquet(path)


def read_box(spark: SparkSession, path: str, lo: Sequence[int], hi: Sequence[int], edge: int = 128) -> DataFrame:
    """Voxels of a box from stored bricks: the box becomes ranges of shard and brick keys, which prune folders and row groups before anything is decoded."""
    cond = F.lit(True)
    for c, a, b in zip(ZYX, lo, hi, strict=True):
        first, last = a // edge, (b - 1) // edge
        cond = cond & F.col("b" + c).between(first, last) & F.col("s" + c).between(first // 8, last // 8)
    found = spark.read.parquet(path).where(cond).where("vmax > 0").select(F.col("bz").alias("cz"), F.col("by").alias("cy"), F.col("bx").alias("cx"), "data", F.lit("present").alias("status"))
    from lamina.operators.volume import box

    return box(decoded_chunks(found, edge), lo, hi)


def raw_voxels(chunks: DataFrame, edge: int) -> DataFrame:
    """Voxels of raw chunks (cz, cy, cx, data), zeros left out; chunks without data have none, and one of another size is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cz, cy, cx, data in zip(b["cz"], b["cy"], b["cx"], b["data"], strict=True):
                a = np.frombuffer(data, np.uint8).reshape((edge,) * 3)
                z, y, x = np.nonzero(a)
                yield pd.DataFrame({"z": z + cz * edge, "y": y + cy * edge, "x": x + cx * edge, "v": a[z, y, x]}).astype("int32")

    return chunks.where("data is not null").select("cz", "cy", "cx", "data").mapInPandas(run, "z int, y int, x int, v int")


def write_mirror(v: DataFrame, path: str, edge: int, known: DataFrame) -> None:
    """A mirror's files: raw chunks z.y.x of the volume, and empty z.y.x.missing for those of ``known(cz, cy, cx)`` that it has no voxel in."""
    key = [F.expr(f"cast({c} div {edge} as int)").alias("c" + c) for c in ZYX]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((edge,) * 3, np.uint8)
        a[g["z"] % edge, g["y"] % edge, g["x"] % edge] = g["v"]
        return pd.DataFrame([("{}.{}.{}".format(*key), a.tobytes())], columns=["name", "data"])

    inside = v.where("v > 0").select(*ZYX, "v", *key)
    gone = known.select("cz", "cy", "cx").distinct().join(inside.select("cz", "cy", "cx").distinct(), ["cz", "cy", "cx"], "left_anti")
    marks = gone.select(F.concat_ws(".", "cz", "cy", "cx", F.lit("missing")).alias("name"), F.lit(b"").alias("data"))
    write_files(inside.groupBy("cz", "cy", "cx").applyInPandas(run, "name string, data binary").union(marks), path)


class SyntheticVolume(DataSource):
    """``spark.read.format("lamina_synthetic").options(kind="sphere|shells|gyroid", size=n)``: a volume made slice by slice."""

    @classmethod
    def name(cls) -> str:
        return "lamina_synthetic"

    def schema(self) -> str:
        return "z int, y int, x int, v int"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _SyntheticReader(self.options.get("kind", "sphere"), int(self.options.get("size", 32)))


class _SyntheticReader(DataSourceReader):
    def __init__(self, kind: str, size: int) -> None:
        self.kind, self.size = kind, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(self.size, a + 16))) for a in range(0, self.size, 16)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = self.size
        y, x = np.mgrid[0:n, 0:n]
        for z in range(*partition.value):
            p = [(a + 0.5) / n * 2 - 1 for a in (np.full_like(y, z), y, x)]
            r = np.sqrt(p[0] ** 2 + p[1] ** 2 + p[2] ** 2)
            if self.kind == "sphere":
                v = np.where(r < 0.8, 255 * (1 - r), 0)
            elif self.kind == "shells":
                v = np.where(r < 0.9, 255 * np.sin(r * 40) ** 2, 0)
            else:
                s, c = ([f(np.pi * 3 * a) for a in p] for f in (np.sin, np.cos))
                v = np.where(np.abs(s[0] * c[1] + s[1] * c[2] + s[2] * c[0]) < 0.4, 220, 0)
            v = v.astype(int)
            for yy, xx in zip(*np.nonzero(v), strict=True):
                yield int(z), int(yy), int(xx), int(v[yy, xx])


def brick_name(name: str) -> tuple[int, int, int] | None:
    """Brick position from a file name such as z012_y003_x004."""
    m = re.search(r"z(\d+)_y(\d+)_x(\d+)", name)
    return tuple(map(int, m.groups())) if m else None


def incomplete(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Bricks inside the bounding box of the named ones that have no file."""
    key = [F.regexp_extract(name_col, r"z(\d+)_y(\d+)_x(\d+)", k).try_cast("int").alias(c) for k, c in ((1, "bz"), (2, "by"), (3, "bx"))]
    have = names.select(*key).where("bz is not null").distinct()
    box = have.agg(*(f(c).alias(n + c) for c in ("bz", "by", "bx") for f, n in ((F.min, "lo_"), (F.max, "hi_"))))
    for c in ("bz", "by", "bx"):
        box = box.withColumn(c, F.explode(F.sequence("lo_" + c, "hi_" + c)))
    return box.select("bz", "by", "bx").join(have, ["bz", "by", "bx"], "left_anti")
