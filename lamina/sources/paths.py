"""Slices of polylines: cross-sections of sheets in three families of planes, a file a slice.

A file holds the paths of one slice and an index of square buckets. All numbers are big-endian. The
header names the slice's extent, the buckets' side and where index and paths begin; the index gives
of each bucket the places of its paths, bucket by bucket; a path is its first point, the length of
its steps in bytes, and a signed byte each for the steps in u and v. A file without a byte is a slice
that has no path; listings pass over it, so it has no row anywhere. A path is written as one row, and a slice's index as one; paths are streamed to
their file in order, so no task holds a slice's paths.

Defined results: a longer step than a signed byte holds is written as several; negative places are
an error, places beyond the extent belong to the last bucket; a path of one point has an entry in the
index and no line; a file of another form or version, or with an index that doesn't fit, has the
status "bad" and no lines; a path that doesn't fit into its file is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.session import by_shuffle, saved
from lamina.sources.files import write_files

#: The format's fixed values: its mark, its version and the bytes of its header.
MARK, VERSION, HEADER = 0x56434753, 3, 52
#: The longest step that is written as one.
LONGEST = 127
SLICE = ["plane", "slice"]
#: Names, and rows of decoded files, that a task hands on at once.
NAMES, ROWS = 10_000, 100_000
LINES = "plane string, slice int, rec long, k int, u0 double, v0 double, u1 double, v1 double, pu double, pv double, nu double, nv double"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A record for each path (plane, slice, path_id, pts), where ``pts`` are its points in order."""
    for batch in batches:
        pts = batch.column("pts")
        flat = pts.flatten()
        at = np.asarray(pts.offsets, np.int64)
        at = at - at[0]
        u, v = (np.asarray(flat.field(c), np.int64) for c in "uv")
        path = np.repeat(np.arange(len(pts)), np.diff(at))
        du, dv = np.diff(u), np.diff(v)
        n = np.where(path[1:] == path[:-1], np.maximum(1, -(-np.maximum(abs(du), abs(dv)) // LONGEST)), 0)
        step = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(step)) - np.repeat(_starts(n), n)
        part = lambda d, k: (2 * d[step] * k + n[step]) // (2 * n[step])
        delta = np.stack([part(d, t + 1) - part(d, t) for d in (du, dv)], 1).astype(np.int8)
        count = np.bincount(path[:-1], n, len(pts)).astype(np.int64) if len(n) else np.zeros(len(pts), np.int64)
        size = 12 + 2 * count
        ends = np.concatenate(([0], np.cumsum(size)))
        data = np.zeros(ends[-1], np.uint8)
        head = np.zeros(len(data), bool)
        head[(ends[:-1, None] + np.arange(12)).ravel()] = True
        data[head] = np.stack([u[at[:-1]], v[at[:-1]], 2 * count], 1).astype(">u4").view(np.uint8).ravel()
        data[~head] = delta.view(np.uint8).ravel()
        records = pa.Array.from_buffers(pa.binary(), len(pts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*SLICE, "path_id")), records], [*SLICE, "path_id", "data"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header and index of slices (name, n, w, h, cell, entries), where ``entries`` are (bucket, place) in order."""
    for batch in batches:
        out = []
        for *form, entries in zip(*(batch.column(c).to_pylist() for c in ("n", "w", "h", "cell")), batch.column("entries"), strict=True):
            n, w, h, cell = form
            buckets = -(-w // cell) * -(-h // cell)
            b, off = (np.asarray(entries.values.field(c), np.int64) for c in ("b", "off"))
            first = np.searchsorted(b, np.arange(buckets + 1))
            begin = HEADER + 4 * (buckets + 1 + len(off))
            header = [MARK, VERSION, 0, 0, w, h, cell, buckets, n, HEADER, begin, 0, 0]
            out.append(np.concatenate((header, first, off)).astype(">u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "data"])


def write_slices(points: DataFrame, path: str, extents: dict[str, tuple[int, int]], cell: int = 64) -> None:
    """Writes ``points(plane, slice, path_id, k, u, v)``, whole numbers, as files plane/slice.grid in the folder ``path``; ``extents`` has those of each plane family's slices."""
    w, h = (F.coalesce(*(F.when(F.col("plane") == p, F.lit(e[k])) for p, e in extents.items()), F.raise_error(F.lit("a plane family has no extent")).cast("int")) for k in (0, 1))
    points = points.select("plane", F.col("slice").cast("int").alias("slice"), F.col("path_id").cast("long").alias("path_id"), "k", *(F.col(c).cast("long").alias(c) for c in "uv"))
    paths = points.groupBy(*SLICE, "path_id").agg(F.sort_array(F.collect_list(F.struct("k", "u", "v"))).alias("pts"))
    records = saved(paths.mapInArrow(_encoded, "plane string, slice int, path_id long, data binary"))
    by = Window.partitionBy(*SLICE).orderBy("path_id")
    size = F.length("data").cast("long")
    placed = records.select(*SLICE, "path_id", (F.sum(size).over(by) - size).alias("off"))

    along = Window.partitionBy(*SLICE, "path_id").orderBy("k")
    ends = points.select(*SLICE, "path_id", *"uv", *(F.lead(c, 1).over(along).alias(f"{c}1") for c in "uv"), w.alias("w"), h.alias("h"))

    def touched(c: str, size: str):
        other = F.coalesce(F.col(c + "1"), F.col(c))
        least = F.when(F.col(c) < 0, F.raise_error(F.lit("a path has a negative place")).cast("long")).otherwise(F.least(F.col(c), other))
        last = F.expr(f"({size} - 1) div {cell}")
        return F.explode(F.sequence(F.least(last, F.floor(least / cell)), F.least(last, F.floor(F.greatest(F.col(c), other) / cell))))

    entries = ends.withColumn("bx", touched("u", "w")).withColumn("by", touched("v", "h"))
    entries = entries.select(*SLICE, "path_id", (F.col("by") * F.ceil(F.col("w") / cell) + F.col("bx")).alias("b")).distinct()
    name = F.format_string("%s/%06d.grid", "plane", "slice").alias("name")
    whole = entries.join(by_shuffle(placed), [*SLICE, "path_id"]).groupBy(*SLICE).agg(F.count_distinct("path_id").alias("n"), F.sort_array(F.collect_list(F.struct("b", "off"))).alias("entries"))
    index = whole.select(name, "n", w.alias("w"), h.alias("h"), F.lit(cell).alias("cell"), "entries").mapInArrow(_index, "name string, data binary")
    parts = index.select("name", F.lit(None).cast("long").alias("path_id"), "data").union(records.select(name, "path_id", "data"))
    write_files(parts.repartition("name").sortWithinPartitions("name", F.asc_nulls_first("path_id")).select("name", "data"), path)


def _decoded(data: bytes) -> dict | None:
    """Extent, buckets and paths of a file; None if it isn't of the form."""
    n = len(data)
    if n < HEADER:
        return None
    head = np.frombuffer(data, ">u4", HEADER // 4).astype(np.int64)
    mark, version, _, _, w, h, cell, buckets, _, index, begin, after, _ = head.tolist()
    if mark != MARK or version != VERSION or not cell or max(w, h) > 1 << 24 or buckets != -(-w // cell) * -(-h // cell):
        return None
    end = after if 0 < after <= n else n
    if index + 4 * (buckets + 1) > n or not index + 4 * (buckets + 1) <= begin <= end:
        return None
    first = np.frombuffer(data, ">u4", buckets + 1, index).astype(np.int64)
    if begin - index - 4 * (buckets + 1) < 4 * first[-1] or (np.diff(first) < 0).any() or first[0]:
        return None
    places = np.frombuffer(data, ">u4", int(first[-1]), index + 4 * (buckets + 1)).astype(np.int64)
    body = np.frombuffer(data, np.uint8, end - begin, begin)
    fits = places + 12 <= len(body)
    rec = np.unique(places[fits])
    header = body[rec[:, None] + np.arange(12)].reshape(-1, 12).view(">u4").astype(np.int64).reshape(-1, 3)
    whole = (rec + 12 + header[:, 2] <= len(body)) & (header[:, 2] % 2 == 0)
    bucket = np.repeat(np.arange(buckets), np.diff(first))
    known = np.isin(places, rec[whole])
    return {"w": w, "h": h, "cell": cell, "across": -(-w // cell), "bucket": bucket[known], "place": places[known], "rec": rec[whole], "header": header[whole], "body": body}


def _lines_of(got: dict) -> pd.DataFrame:
    rec, header = got["rec"], got["header"]
    n = header[:, 2] // 2
    path = np.repeat(np.arange(len(rec)), n)
    k = np.arange(len(path)) - np.repeat(_starts(n), n)
    cols = {"rec": rec[path], "k": k}
    last = k == n[path] - 1
    for a, c in enumerate("uv"):
        d = got["body"][rec[path] + 12 + 2 * k + a].view(np.int8).astype(np.int64)
        total = np.cumsum(d)
        before = np.concatenate(([0], total))[_starts(n)]
        end = header[path, a] + total - before[path]
        start = end - d
        cols |= {c + "0": start, c + "1": end, "p" + c: np.where(k > 0, np.roll(start, 1), np.nan), "n" + c: np.where(last, np.nan, np.roll(end, -1))}
    return pd.DataFrame(cols)


def _buckets_of(got: dict) -> pd.DataFrame:
    return pd.DataFrame({"bx": got["bucket"] % got["across"], "by": got["bucket"] // got["across"], "rec": got["place"], "cell": got["cell"], "w": got["w"], "h": got["h"]})


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slice files, not empty, in the folders ``path`` and those below; as for Spark, names that begin with ``_`` or ``.`` are hidden."""
    for b in batches:
        for top in b["path"]:
            top = top.replace("file:/", "file:///", 1) if top.startswith("file:/") and not top.startswith("file:///") else top
            store, root = stores.FileSystem.from_uri(top)
            found = store.get_file_info(stores.FileSelector(root, recursive=True))
            names = [f.path for f in found if f.is_file and f.size and f.path.endswith(".grid") and not any(p[:1] in "_." for p in f.path[len(root) :].strip("/").split("/"))]
            for k in range(0, len(names), NAMES):
                yield pd.DataFrame({"top": top, "path": names[k : k + NAMES]})


def _read(spark: SparkSession, path: str, what: Callable[[dict | None], pd.DataFrame | None], schema: str) -> DataFrame:
    """``what`` of every file, which are opened one at a time in tasks; None stands for a file of another form.

    The folder is listed by a task and its names are dealt over tasks: the driver would hold each
    file's status, and plan a share of a task for it.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.createDataFrame([(path,)], "path string").mapInPandas(_listed, "top string, path string").repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, rows = [], 0
        for b in batches:
            for top, inner in zip(b["top"], b["path"], strict=True):
                store, _ = stores.FileSystem.from_uri(top)
                with store.open_input_stream(inner) as f:
                    data = f.read()
                got = what(_decoded(data))
                if got is None:
                    continue
                plane, name = inner.split("/")[-2:]
                out.append(got.assign(plane=plane, slice=int(name.partition(".")[0])))
                rows += len(got)
                if rows >= ROWS:
                    yield pd.concat(out, ignore_index=True)
                    out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return names.mapInPandas(run, schema)


def slice_lines(spark: SparkSession, path: str) -> DataFrame:
    """The steps of all paths: ``rec`` names a path in its slice, (u0, v0) and (u1, v1) are a step's ends, (pu, pv) and (nu, nv) those before and after, null at a path's end."""
    return _read(spark, path, lambda got: _lines_of(got) if got else None, LINES).replace(float("nan"), None)


def slice_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The index of all slices: the paths in each bucket (bx, by)."""
    return _read(spark, path, lambda got: _buckets_of(got) if got else None, "plane string, slice int, bx long, by long, rec long, cell long, w long, h long")


def slice_status(spark: SparkSession, path: str) -> DataFrame:
    """``status`` of each slice that isn't empty: paths or bad; and its number of paths."""

    def what(got: dict | None) -> pd.DataFrame:
        return pd.DataFrame({"status": ["bad" if got is None else "paths"], "n": [len(got["rec"]) if got else 0]})

    return _read(spark, path, what, "plane string, slice int, status string, n long")


def paths_at(buckets: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Distinct paths (pt_id, plane, slice, rec) in the buckets that the square about each of ``points(pt_id, plane, slice, u, v)`` touches.

    The square's corner and side lose their fractions, and it is cut to the slice's extent; an empty one finds nothing.
    """
    form = buckets.select(*SLICE, "cell", "w", "h").distinct()
    at = points.join(by_shuffle(form), SLICE)
    span = []
    for c, size in (("u", "w"), ("v", "h")):
        low = (F.col(c) - radius).cast("long")
        lo, hi = F.greatest(F.lit(0), low), F.least(F.col(size), low + int(2 * radius))
        last = F.expr(f"({size} - 1) div cell")
        span.append((lo, hi, F.sequence(F.floor(lo / F.col("cell")), F.least(last, F.floor(F.greatest(lo, hi) / F.col("cell"))))))
    at = at.where((span[0][0] < span[0][1]) & (span[1][0] < span[1][1]))
    at = at.withColumn("bx", F.explode(span[0][2])).withColumn("by", F.explode(span[1][2]))
    return at.select("pt_id", *SLICE, "bx", "by").join(by_shuffle(buckets.select(*SLICE, "bx", "by", "rec")), [*SLICE, "bx", "by"]).select("pt_id", *SLICE, "rec").distinct()
