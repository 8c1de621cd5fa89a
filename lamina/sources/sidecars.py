"""JSON sidecars, listings and manifests: read with fixed schemas, written as one row of text."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.sampling import inverse
from lamina.operators.stats import safe_name


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """Files as one row each, ``value``."""
    return spark.read.text(path, wholetext=True)


def small_file(spark: SparkSession, path: str) -> DataFrame:
    """One small file as a row, ``value``, also where its name begins with a dot, which Spark's readers pass over."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark.createDataFrame([(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"),)], "value string")
    finally:
        stream.close()


def axis_points(text: DataFrame) -> DataFrame:
    """``axis_point(z, x, y)`` from JSON with control_points, points, or an array at the top; points are objects or [z, y, x]."""
    obj, arr = "array<struct<x: double, y: double, z: double>>", "array<array<double>>"
    every = []
    for shape in ("control_points", "points", None):
        for kind in (obj, arr):
            parsed = F.from_json("value", f"struct<{shape}: {kind}>")[shape] if shape else F.from_json("value", kind)
            if kind == arr:
                parsed = F.transform(parsed, lambda p: F.struct(F.get(p, F.lit(2)).alias("x"), F.get(p, F.lit(1)).alias("y"), F.get(p, F.lit(0)).alias("z")))
            every.append(F.filter(parsed, lambda p: p["z"].isNotNull() & p["x"].isNotNull() & p["y"].isNotNull()))
    best = F.coalesce(*(F.when(F.size(e) > 0, e) for e in every))
    p = text.select(F.explode(best).alias("p")).select("p.z", "p.x", "p.y")
    return p.groupBy("z").agg(F.max(F.struct("x", "y")).alias("s")).select("z", "s.x", "s.y")


def axis_json(axis: DataFrame) -> DataFrame:
    """The axis as JSON under both names; an axis has a point for some hundred slices at most."""
    pts = F.array_sort(F.collect_list(F.struct("z", "x", "y")))
    return axis.agg(F.to_json(F.struct(pts.alias("control_points"), pts.alias("points"))).alias("value"))


def pull_matrix(text: DataFrame) -> list[list[float]]:
    """The map fixed to moving: ``pull_matrix_xyz`` as it is, or the published ``transformation_matrix`` inverted."""
    row = text.select(
        F.from_json("value", "pull_matrix_xyz array<array<double>>")["pull_matrix_xyz"].alias("pull"),
        F.from_json("value", "transformation_matrix array<array<double>>")["transformation_matrix"].alias("push"),
    ).first()
    found = row["pull"] or row["push"]
    if not found or [len(r) for r in found[:3]] != [4, 4, 4] or not all(math.isfinite(x) for r in found[:3] for x in r):
        raise ValueError("no 3 by 4 matrix")
    return [list(r) for r in found[:3]] if row["pull"] else inverse(found[:3])


def transform_json(spark: SparkSession, pull: Sequence[Sequence[float]]) -> DataFrame:
    """Both directions of a map as JSON."""
    row = spark.createDataFrame([([list(map(float, r)) for r in pull], inverse(pull))], "pull_matrix_xyz array<array<double>>, transformation_matrix array<array<double>>")
    return row.select(F.to_json(F.struct("*")).alias("value"))


def level_table(text: DataFrame) -> DataFrame:
    """``level_meta(level, scale, nz, ny, nx)`` of a tree's manifest.json; at most 8 levels, scale 2**level."""
    m = text.select(F.from_json("value", "levels array<struct<level: int, shape: array<int>>>").alias("m")).select(F.explode("m.levels").alias("l"))
    out = m.select(F.col("l.level").alias("level"), F.expr("shiftleft(1, l.level)").alias("scale"), *(F.get("l.shape", F.lit(k)).alias(n) for k, n in enumerate(("nz", "ny", "nx"))))
    return out.where("level >= 0 and level < 8 and nz > 0 and ny > 0 and nx > 0")


def zarr_levels(text: DataFrame) -> DataFrame:
    """Shape, chunks, type and fill of the texts of .zarray files."""
    m = text.select(F.from_json("value", "shape array<int>, chunks array<int>, dtype string, fill_value int, order string, zarr_format int").alias("m"))
    return m.select("m.*").where("zarr_format = 2 and size(shape) = 3 and size(chunks) = 3")


def seeds(text: DataFrame) -> DataFrame:
    """``seed(k, x, y, z)`` of a seeds file: an array of [x, y, z], or under the name seeds."""
    a = F.coalesce(F.from_json("value", "seeds array<array<double>>")["seeds"], F.from_json("value", "array<array<double>>"))
    p = text.select(F.posexplode(a).alias("k", "p")).where("size(p) = 3")
    return p.select("k", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")))


def listing_entries(pages: DataFrame) -> DataFrame:
    """``listing(kind, name, size)`` of the XML pages (seq, status, body) of an object store's listing; names that aren't safe are dropped.

    Pages that failed, or aren't listings, give nothing: see ``listing_complete``.
    """
    good = pages.where((F.col("status") == 200) & F.col("body").contains("<ListBucketResult"))
    folder = good.select(F.explode(F.regexp_extract_all("body", F.lit(r"<CommonPrefixes><Prefix>([^<]*)</Prefix>"), F.lit(1))).alias("key"), F.lit("prefix").alias("kind"), F.lit(None).cast("long").alias("size"))
    item = good.select(F.explode(F.regexp_extract_all("body", F.lit(r"<Contents>(.*?)</Contents>"), F.lit(1))).alias("c"))
    item = item.select(F.regexp_extract("c", "<Key>([^<]*)</Key>", 1).alias("key"), F.lit("object").alias("kind"), F.regexp_extract("c", "<Size>([0-9]+)</Size>", 1).try_cast("long").alias("size"))
    name = F.regexp_extract(F.rtrim(F.col("key"), F.lit("/")), r"([^/]*)$", 1)
    return folder.unionByName(item).select("kind", name.alias("name"), "size").where(safe_name(F.col("name"))).distinct()


def fetch_listing(spark: SparkSession, fetch: Callable[[str | None], tuple[int, str]], most: int = 32) -> DataFrame:
    """Pages of a listing by continuation token, fail closed: an error page, something else than a listing, or more than ``most`` pages is an error."""
    import re

    rows, token = [], None
    for seq in range(most):
        status, body = fetch(token)
        if status != 200 or "<ListBucketResult" not in body:
            raise OSError(f"page {seq} isn't a listing (status {status})")
        rows.append((seq, status, body))
        found = re.search("<NextContinuationToken>([^<]+)<", body)
        if "<IsTruncated>true" not in body or not found:
            return listing_entries(spark.createDataFrame(rows, "seq int, status int, body string"))
        token = found[1]
    raise OSError(f"the listing has more than {most} pages")


def as_json(rows: DataFrame, *group: Column) -> DataFrame:
    """Each row as one line of JSON."""
    return rows.select(*group, F.to_json(F.struct("*")).alias("value"))
