"""The relations that volume and surface operators work on, derived from the star-schema tables.

Each comes as a DataFrame and as the SQL that states it (``SQL``), for oracles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import table


#: Rows of a table that explodes to neighbourhoods in one task, and the side of a patch of cells that stays together.
TASK_ROWS, PATCH = 20_000, 8


def _dealt(df: DataFrame, rows: int, *keys: Column) -> DataFrame:
    """``df`` dealt over tasks by its ``rows``: a small file is read by one task, which would make all neighbourhoods alone."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``voxel(z, y, x, v)``: 32**3, absent rows are 0, values 5 to 250 in steps of 5."""
    li = table(spark, sf_dir, "lineitem")
    axes = [(F.col(c) % 32).cast("int").alias(n) for c, n in (("l_orderkey", "z"), ("l_partkey", "y"), ("l_suppkey", "x"))]
    return li.groupBy(*axes).agg((F.max(F.floor("l_quantity").cast("long")) * 5).cast("int").alias("v"))


def grown_side(spark: SparkSession, sf_dir: str) -> int:
    """Side of a volume that grows with the rows of lineitem: 32, doubled for each eightfold of 32**3 rows, to the nearest."""
    rows = table(spark, sf_dir, "lineitem").count()
    return 32 << max(0, math.floor(math.log2(max(rows, 1) / 32**3) / 3 + 0.5))


def grown_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``voxels``, with the side of ``grown_side``."""
    return sided_voxels(spark, sf_dir, grown_side(spark, sf_dir))


def sided_voxels(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """As ``voxels``, with a side of ``n``."""
    axes = [(F.col(c) % n).cast("int").alias(k) for c, k in (("l_orderkey", "z"), ("l_partkey", "y"), ("l_suppkey", "x"))]
    return table(spark, sf_dir, "lineitem").groupBy(*axes).agg((F.max(F.floor("l_quantity").cast("long")) * 5).cast("int").alias("v"))


def surface_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sp(seg_id, j, i, x, y, z)``: segments of 10 by 50 cells; points that aren't valid are absent."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    z = F.when(size % 17 == 0, 0).otherwise(F.floor("p_retailprice").cast("long") - 850)
    cell = p.select(
        F.expr("p_partkey div 500").cast("int").alias("seg_id"),
        (F.expr("p_partkey div 50") % 10).cast("int").alias("j"),
        (k % 50).cast("int").alias("i"),
        (20 * (k % 50) + size % 5).cast("double").alias("x"),
        (20 * F.expr("p_partkey div 50") + size % 3).cast("double").alias("y"),
        z.cast("double").alias("z"),
    )
    patch = (F.col("seg_id"), *(F.expr(f"{c} div {PATCH}") for c in "ji"))
    return _dealt(cell.where("z > 0"), p.count(), *patch)


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qp(pt_id, x, y, z)``: quarter-voxel positions inside the volume."""
    e = table(spark, sf_dir, "events")
    quarter = lambda c: ((c % 124).cast("double") / 4)
    q = e.select(F.col("event_id").alias("pt_id"), quarter(F.col("user_id")).alias("x"), quarter(F.col("event_id")).alias("y"), quarter(F.col("event_id") * 7 + F.col("user_id")).alias("z"))
    return _dealt(q, e.count() // 5, F.col("pt_id"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample(metric, idx, ns)``: timing samples."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("idx"), F.floor(F.col("value") * 100).cast("long").alias("ns"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lab(z, y, x, cls)``: sparse classes 1 to 7."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    axes = [(F.col(c) % 32).cast("int").alias(n) for c, n in (("l_orderkey", "z"), ("l_partkey", "y"), ("l_suppkey", "x"))]
    return li.groupBy(*axes).agg(F.max("l_linenumber").cast("int").alias("cls"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pred(vec_id, py, px, p)``: 8 by 8 maps."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e"))
    return e.select("vec_id", F.expr("k div 8").cast("int").alias("py"), (F.col("k") % 8).cast("int").alias("px"), F.col("e").cast("double").alias("p"))


SQL = {
    "voxel": """SELECT CAST(l_orderkey % 32 AS INT) AS z, CAST(l_partkey % 32 AS INT) AS y, CAST(l_suppkey % 32 AS INT) AS x,
 CAST(MAX(CAST(floor(l_quantity) AS BIGINT)) * 5 AS INT) AS v FROM lineitem GROUP BY 1, 2, 3""",
    "side": "SELECT CAST(32 * pow(2, greatest(0, floor(log2(count(*) / 32768e0) / 3 + 0.5))) AS INT) AS n FROM lineitem",
    "grown": """SELECT CAST(l_orderkey % n AS INT) AS z, CAST(l_partkey % n AS INT) AS y, CAST(l_suppkey % n AS INT) AS x,
 CAST(MAX(CAST(floor(l_quantity) AS BIGINT)) * 5 AS INT) AS v FROM lineitem, side GROUP BY 1, 2, 3""",
    "sp": """SELECT * FROM (SELECT CAST(p_partkey // 500 AS INT) AS seg_id, CAST((p_partkey // 50) % 10 AS INT) AS j, CAST(p_partkey % 50 AS INT) AS i,
 CAST(20 * (p_partkey % 50) + p_size % 5 AS DOUBLE) AS x, CAST(20 * (p_partkey // 50) + p_size % 3 AS DOUBLE) AS y,
 CAST(CASE WHEN p_size % 17 = 0 THEN 0 ELSE CAST(floor(p_retailprice) AS BIGINT) - 850 END AS DOUBLE) AS z FROM part) WHERE z > 0""",
    "qp": """SELECT event_id AS pt_id, CAST(user_id % 124 AS DOUBLE) / 4 AS x, CAST(event_id % 124 AS DOUBLE) / 4 AS y,
 CAST((event_id * 7 + user_id) % 124 AS DOUBLE) / 4 AS z FROM events""",
    "sample": "SELECT event_type AS metric, event_id AS idx, CAST(floor(value * 100) AS BIGINT) AS ns FROM events",
    "lab": """SELECT CAST(l_orderkey % 32 AS INT) AS z, CAST(l_partkey % 32 AS INT) AS y, CAST(l_suppkey % 32 AS INT) AS x,
 CAST(MAX(l_linenumber) AS INT) AS cls FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3""",
    "pred": """SELECT vec_id, CAST((k - 1) // 8 AS INT) AS py, CAST((k - 1) % 8 AS INT) AS px, CAST(embedding[k] AS DOUBLE) AS p
 FROM embeddings, (SELECT unnest(range(1, 65)) AS k)""",
    "grid": """SELECT CAST(a.k AS INT) AS z, CAST(b.k AS INT) AS y, CAST(c.k AS INT) AS x
 FROM (SELECT unnest(range(0, 32)) AS k) a, (SELECT unnest(range(0, 32)) AS k) b, (SELECT unnest(range(0, 32)) AS k) c""",
    "dense": "SELECT z, y, x, CAST(coalesce(v, 0) AS INT) AS v FROM grid LEFT JOIN voxel USING (z, y, x)",
}


def with_sql(names: str, body: str) -> str:
    """``body`` with the named relations defined before it."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + body
