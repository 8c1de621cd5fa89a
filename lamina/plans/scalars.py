"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import scalars as sc
from lamina.functions.derive import surface_points, with_sql
from lamina.plans.points import _scaled, _sqls
from lamina.session import table

DAMPING = 0.5


def _names(s, d):
    """Each event as a run that ends: its folder's path, its file's size and times."""
    n = F.col("event_id")
    path = F.concat(F.lit("runs/"), F.col("event_type"), F.lit("/u"), F.col("user_id").cast("string"), F.when(n % 3 == 0, "/").otherwise(""))
    runs = table(s, d, "events").select("event_id", path.alias("path"), F.date_trunc("minute", "ts").alias("ts"), F.floor("value").cast("long").alias("size"), "user_id")
    base = sc.basename(F.col("path"))
    source = F.when(n % 5 > 0, F.col("ts") + F.make_dt_interval(hours=F.lit(1) - n % 3))
    return sc.finish_names(runs, "ts", "event_id").select(
        "event_id", base.alias("base"), sc.fnv1a64(base).alias("hash"), "finish_name", sc.fresh(F.col("size"), F.col("ts"), source).alias("fresh"),
        F.floor(sc.pixel_hash(n * 40503, F.col("user_id"), n) * 1_000_000).cast("long").alias("jitter"),
    )


_NAMES = f"""WITH e AS (SELECT event_id, 'u' || user_id AS base, date_trunc('minute', ts) AS ts, floor(value) AS size, user_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY event_id) AS k, strftime(ts, '%Y%m%d%H%M%S') AS s, CASE WHEN event_id % 5 > 0 THEN ts + to_hours(CAST(1 - event_id % 3 AS INT)) END AS source,
 (event_id * 40503 % 4294967296 * {sc.PIXEL_X} + user_id * {sc.PIXEL_Y} + event_id * {sc.PIXEL_FRAME}) % 4294967296 AS h FROM e),
m AS (SELECT *, xor(h, h >> 13)::HUGEINT * {sc.PIXEL_MIX} % 4294967296 AS g FROM n),
u AS (SELECT base, list_reduce(list_prepend({sc.FNV_START}::HUGEINT, list_transform(string_split(base, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: xor(h, b) * {(1 << 40) + sc.FNV_PRIME_LOW}::HUGEINT % 18446744073709551616::HUGEINT) AS f FROM (SELECT DISTINCT base FROM e))
SELECT event_id, base, lower(printf('%08x%08x', CAST(f // 4294967296 AS BIGINT), CAST(f % 4294967296 AS BIGINT))) AS hash, CASE WHEN k = 1 THEN s ELSE s || '-' || k END AS finish_name, size > 0 AND (source IS NULL OR ts >= source) AS fresh,
 CAST(floor(CAST(g // 256 AS BIGINT) / 16777216e0 * 1000000) AS BIGINT) AS jitter FROM m JOIN u USING (base)"""

_UPPER = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def _steps(s, d):
    """Of each grid row the damped step towards the plane on which its cells count up."""
    sp = surface_points(s, d).select("seg_id", "j", "i", *((F.col(c) / 256).alias(c) for c in "xyz"))
    sums = sp.groupBy("seg_id", "j").agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in _UPPER), *(F.sum(F.col(c) * F.col("i")).alias("b" + c) for c in "xyz"))
    step = sc.damped_step([F.col(a + b) for a, b in _UPPER], [F.col("b" + c) for c in "xyz"], DAMPING)
    return sums.select("seg_id", "j", *(v.alias("d" + c) for c, v in zip("xyz", step, strict=True))).select("seg_id", "j", *(_scaled(f"d{c}", 4) for c in "xyz"))


def _steps_sql():
    """By Cramer's rule: the unknown's column replaced by the other side."""
    m = {(a, b): f"{min(a, b)}{max(a, b)}" for a in "xyz" for b in "xyz"}
    det = lambda c: f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]}) + {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]}))"
    rows = [[m[a, b] for b in "xyz"] for a in "xyz"]
    replaced = [[[f"-o{a}" if b == c else m[a, b] for b in "xyz"] for a in "xyz"] for c in "xyz"]
    return with_sql(
        "sp",
        ", q AS (SELECT seg_id, j, i, x / 256 AS x, y / 256 AS y, z / 256 AS z FROM sp), s AS (SELECT seg_id, j, " + ", ".join(f"sum({a} * {b}) * {1 + DAMPING if a == b else 1}e0 AS {a}{b}" for a, b in _UPPER) + ", " + ", ".join(f"sum({c} * i) AS o{c}" for c in "xyz")
        + " FROM q GROUP BY 1, 2) SELECT seg_id, j, " + ", ".join(_sqls(f"CASE WHEN abs({det(rows)}) >= 1e-30 THEN {det(r)} / {det(rows)} END", f"d{c}", 4) for c, r in zip("xyz", replaced, strict=True)) + " FROM s",
    )


QUERIES = {
    "x11_names_hashes_times": (_names, _NAMES),
    "x11_damped_steps": (_steps, _steps_sql()),
}
