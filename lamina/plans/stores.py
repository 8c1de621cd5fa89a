"""Queries that write a format from derived tables and read it back, streams over files, and users' functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import hooks
from lamina.functions.derive import labels, query_points, samples, surface_points, voxels, with_sql
from lamina.operators import axis as ax
from lamina.operators import solve as so
from lamina.operators import stats as st
from lamina.operators import surface as su
from lamina.operators import volume as vo
from lamina.plans.points import AXIS, MATRIX, _axis, _scaled, _sqls
from lamina.session import room, table
from lamina.sources import segments, sidecars, volumes
from lamina.streaming import jobs

SHAPE = (32, 32, 32)
_AX = "xyz"


def _raw(s, d):
    path = f"{room(s, 'raw')}/volume.raw"
    volumes.write_raw(voxels(s, d), path, SHAPE)
    return volumes.raw_volume(s, path, SHAPE)


def _shards(s, d):
    """Chunks of 4 cubed in shards of 2 cubed: present ones, and missing ones where the volume has no voxel."""
    path = room(s, "shards")
    volumes.write_shards(voxels(s, d), path, 4, 2)
    part = lambda c: F.regexp_extract("file", rf"{c}([0-9]+)[_.]", 1).cast("int")
    return volumes.shard_chunks(s, path, 2).select(*(part(c).alias("s" + c) for c in "zyx"), "cz", "cy", "cx", "status", "data")


def _decoded(s, d):
    chunks = _shards(s, d).select(*((F.col("s" + c) * 2 + F.col("c" + c)).alias("c" + c) for c in "zyx"), "status", "data")
    return volumes.decoded_chunks(chunks, 4)


def _bricks(s, d):
    path = room(s, "bricks")
    volumes.write_bricks(volumes.bricks(voxels(s, d), 8), path)
    return volumes.read_box(s, path, (3, 2, 2), (21, 30, 27), 8)


def _text(s, row, name):
    """A one-row frame of text written as a file and read back."""
    path = room(s, name)
    row.write.option("lineSep", "\n").text(path)
    return sidecars.whole_text(s, path).where("value != ''")


def _shape(s, d):
    return voxels(s, d).agg(*(F.max(c).alias(c) for c in "zyx"))


def _levels(s, d):
    one = lambda k: F.struct(F.lit(k).alias("level"), F.array(*(F.expr(f"({c} + {1 << k}) div {1 << k}").cast("int") for c in "zyx")).alias("shape"))
    manifest = _shape(s, d).select(F.to_json(F.struct(F.array(*(one(k) for k in range(4))).alias("levels"))).alias("value"))
    return sidecars.level_table(_text(s, manifest, "manifest"))


def _zarr(s, d):
    meta = _shape(s, d).select(F.to_json(F.struct(F.lit(2).alias("zarr_format"), F.array(*((F.col(c) + 1).cast("int") for c in "zyx")).alias("shape"), F.array(*(F.lit(16),) * 3).alias("chunks"), F.lit("|u1").alias("dtype"), F.lit(0).alias("fill_value"), F.lit("C").alias("order"))).alias("value"))
    return sidecars.zarr_levels(_text(s, meta, "zarray")).select(*(F.get("shape", F.lit(k)).alias("n" + c) for k, c in enumerate("zyx")), F.get("chunks", F.lit(0)).alias("chunk"), "dtype", "fill_value")


def _mirror(s, d):
    """Chunks of 4 cubed that hold a voxel, markers for the others of the lower half."""
    path = room(s, "mirror")
    known = s.range(256).select((F.expr("id div 64")).cast("int").alias("cz"), F.expr("cast(id div 8 % 8 as int)").alias("cy"), (F.col("id") % 8).cast("int").alias("cx"))
    volumes.write_mirror(voxels(s, d), path, 4, known)
    return volumes.mirror_status(s, path, (8, 8, 8)).select("cz", "cy", "cx", "status", F.length("data").alias("bytes"))


def _tiff(s, d):
    path = room(s, "surfaces")
    segments.write_tiff_surfaces(surface_points(s, d).select(F.concat(F.lit("seg"), F.col("seg_id").cast("string")).alias("name"), "j", "i", *_AX), path)
    return segments.tiff_surfaces(s, path).select("name", "j", "i", *(F.col(c).cast("double").alias(c) for c in _AX))


def _store(s, d):
    """All surfaces, moved, then those with even numbers as they are: these replace the first ones."""
    path, sp = room(s, "store"), surface_points(s, d).select(F.col("seg_id").cast("string").alias("name"), "j", "i", *_AX)
    segments.pack(s, path, sp.withColumn("x", F.col("x") + 1000), 4)
    segments.pack(s, path, sp.where("cast(name as int) % 2 = 0"), 4)
    return s.read.parquet(f"{path}/points"), s.read.parquet(f"{path}/tiles")


def _axis_file(s, d):
    return sidecars.axis_points(_text(s, sidecars.axis_json(_axis(s, d)), "axis")).select("z", _scaled("x"), _scaled("y"))


def _transform_file(s, d):
    text = _text(s, sidecars.transform_json(s, MATRIX), "transform")
    published = text.select(F.to_json(F.struct(F.from_json("value", "transformation_matrix array<array<double>>")["transformation_matrix"].alias("transformation_matrix"))).alias("value"))
    maps = {way: sidecars.pull_matrix(t) for way, t in (("pull", text), ("published", published))}
    mapped = lambda r: r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3]
    ways = F.array(*(F.struct(F.lit(way).alias("way"), *(mapped(r).alias("m" + c) for c, r in zip(_AX, m, strict=True))) for way, m in maps.items()))
    return query_points(s, d).select("pt_id", F.inline(ways)).select("pt_id", "way", *(_scaled(f"m{c}") for c in _AX))


def _seeds(s, d):
    """The first point of each segment as a seed."""
    first = surface_points(s, d).groupBy("seg_id").agg(F.min(F.struct("j", "i", *_AX)).alias("p"))
    row = first.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "p"))), lambda r: F.array(*(r["p"][c] for c in _AX))).alias("seeds"))).alias("value"))
    return sidecars.seeds(_text(s, row, "seeds"))


def _listing(s, d):
    """Listing pages of 25 suppliers each; every fifth has a name that isn't safe."""
    sup = table(s, d, "supplier")
    name = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "-").otherwise("s"), F.col("s_suppkey").cast("string"))
    item = F.concat(F.lit("<Contents><Key>seg/"), name, F.lit("</Key><Size>"), F.col("s_nationkey").cast("string"), F.lit("</Size></Contents>"))
    pages = sup.groupBy(F.expr("s_suppkey div 25").alias("seq")).agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    return sidecars.listing_entries(pages.select("seq", F.lit(200).alias("status"), F.concat(F.lit("<ListBucketResult>"), "items", F.lit("<CommonPrefixes><Prefix>seg/sub"), F.col("seq").cast("string"), F.lit("/</Prefix></CommonPrefixes></ListBucketResult>")).alias("body")))


def _synthetic(kind):
    """A made volume beside the table's one, where both have a voxel."""

    def run(s, d):
        s.dataSource.register(volumes.SyntheticVolume)
        made = s.read.format("lamina_synthetic").options(kind=kind, size=16).load()
        return made.join(voxels(s, d).withColumnRenamed("v", "seen"), ["z", "y", "x"])

    return run


def _lines(s, d):
    sp = su.around(surface_points(s, d), {"p": (0, 0), "r": (0, 1)}).where("p is not null and r is not null")
    return sp.select((F.col("seg_id") * 10 + F.col("j")).alias("path_id"), F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("r.x").alias("x1"), F.col("r.y").alias("y1"))


def _label_bricks(s, d):
    """All labels saved; then the low slices get other classes and lose their last rows, and only their bricks are written again."""
    path, lab = room(s, "labels"), labels(s, d).withColumn("gen", F.col("z") * 32 + F.col("y"))
    segments.save_labels(s, lab, path, -1, 8)
    low = F.col("z") < 8
    edited = lab.select("z", "y", "x", F.when(low & (F.col("y") >= 24), 0).when(low, F.col("cls") % 7 + 1).otherwise(F.col("cls")).cast("int").alias("cls"), F.when(low, 5000).otherwise(F.col("gen")).alias("gen"))
    segments.save_labels(s, edited, path, 4000, 8)
    return segments.load_labels(s, path, SHAPE)


def _layer_files(s, d):
    path = room(s, "layers")
    stack = voxels(s, d).select(F.lit(0).alias("seg_id"), F.col("z").alias("layer"), F.col("y").alias("j"), F.col("x").alias("i"), "v")
    segments.write_layers(segments.stack_layers(stack, 32, 32), path)
    return segments.layer_pixels(s, path)


def _trace_save(s, d):
    path = room(s, "trace")
    cells = surface_points(s, d).withColumn("conf", F.col("i") % 4 / 4.0)
    segments.save_trace(cells, path, 0.25, 20.0)
    return s.read.parquet(path)


def _brick_names(s, d):
    part = lambda c: F.lpad(F.expr(f"cast({c} div 4 as string)"), 3, "0")
    return voxels(s, d).where("v = 250").select(F.concat(F.lit("z"), part("z"), F.lit("_y"), part("y"), F.lit("_x"), part("x"), F.lit(".zst")).alias("name")).distinct()


def _table_function(s, d):
    s.udtf.register("raw_voxels", hooks.RawVoxels)
    name = f"planes_{id(d)}"
    volumes.planes(voxels(s, d), SHAPE).withColumnRenamed("z", "plane").createOrReplaceTempView(name)
    return s.sql(f"SELECT plane AS z, t.y, t.x, t.v FROM {name}, LATERAL raw_voxels(data, 1, 32, 32) t")


def _stream(s, d):
    return jobs.event_stream(s, f"{d}/events.parquet")


def _latest(s, d):
    req = _stream(s, d).select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("gen"), "event_type")
    return jobs.run_to(jobs.latest_requests(req, "key", "gen", ["event_type"]), room(s, "latest"), room(s, "state"), "complete")


def _changes(s, d):
    return jobs.run_to(jobs.changes_since(_stream(s, d).select("event_id", "user_id"), "event_id", 700), room(s, "changes"), room(s, "state"))


def _report(s, d):
    out = jobs.run_to(jobs.sliding_report(_stream(s, d).select("ts", "event_type", F.floor(F.col("value") * 100).cast("long").alias("ns")), "ts", "event_type", "ns", "1 hour", "3650 days"), room(s, "report"), room(s, "state"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _scaled("mean", 4), "max")


#: How late rows of the streams over a whole table may be: no row of it is lost, in whatever order its files come.
ANY_AGE = "36500 days"
TTL_MS = 6 * 3600 * 1000


def _misses(s, d):
    """Each event asks for its user's item: purchases find it, one in 97 proves it empty, all others miss it."""
    n = F.col("event_id")
    probes = _stream(s, d).select(F.col("user_id").alias("key"), "ts", F.when(n % 97 > 0, F.col("event_type") == "purchase").alias("found"))
    out = jobs.run_to(jobs.negative_cache(probes, TTL_MS, ANY_AGE), room(s, "misses"), room(s, "state"))
    return out.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "verdict")


def _fetches(s, d):
    """Each user's event in an hour asks for one cell; the first one is fetched."""
    asked = _stream(s, d).select("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts")
    return jobs.run_to(jobs.deduplicated_fetches(asked, ["user_id", "event_type", "hour"], "ts", ANY_AGE), room(s, "fetches"), room(s, "state")).select("user_id", "event_type", "hour")


_MISSES = f"""WITH RECURSIVE p AS (SELECT user_id AS key, ts, epoch_ms(ts) AS now, CASE WHEN event_id % 97 > 0 THEN event_type = 'purchase' END AS found, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, n, ts, CASE WHEN found IS NULL THEN 'empty' WHEN found THEN 'found' ELSE 'miss' END AS verdict, CASE WHEN found IS NULL THEN -1 WHEN NOT found THEN now + {TTL_MS} END AS until FROM p WHERE n = 1
UNION ALL SELECT p.key, p.n, p.ts, CASE WHEN until < 0 OR now < until THEN 'cached' WHEN found IS NULL THEN 'empty' WHEN found THEN 'found' ELSE 'miss' END,
 CASE WHEN until < 0 OR now < until THEN until WHEN found IS NULL THEN -1 WHEN NOT found THEN now + {TTL_MS} END FROM r JOIN p ON p.key = r.key AND p.n = r.n + 1)
SELECT key, ts, verdict FROM r"""

FIT = {"r0": [10.0, 14.0, 20.0], "harmonics": [0.5, -0.25, 0.125, 0.0625], "omega": 3.0}


def _populated(s, d):
    grid = surface_points(s, d).select("seg_id", "j", "i", (F.col("i") / 8.0).alias("theta"), (F.col("j") + F.col("i") / 50.0).alias("wind"), (F.col("z") % 100).alias("z"))
    return so.populated(grid, FIT, (5.0, 7.0), 100.0).select("seg_id", "j", "i", *(_scaled(c) for c in _AX))


_SHARDS = """c AS (SELECT DISTINCT z // 4 AS z, y // 4 AS y, x // 4 AS x FROM voxel),
k AS (SELECT s.sz, s.sy, s.sx, a.k AS cz, b.k AS cy, e.k AS cx FROM (SELECT DISTINCT z // 2 AS sz, y // 2 AS sy, x // 2 AS sx FROM c) s, (VALUES (0), (1)) a(k), (VALUES (0), (1)) b(k), (VALUES (0), (1)) e(k))"""

QUERIES = {
    "s1_k10_raw_volume": (_raw, with_sql("voxel", "SELECT * FROM voxel")),
    "s3_s4_shard_index": (
        lambda s, d: _shards(s, d).drop("data"),
        with_sql("voxel", f", {_SHARDS} SELECT CAST(sz AS INT) AS sz, CAST(sy AS INT) AS sy, CAST(sx AS INT) AS sx, cz, cy, cx, CASE WHEN c.z IS NULL THEN 'missing' ELSE 'present' END AS status FROM k LEFT JOIN c ON c.z = sz * 2 + cz AND c.y = sy * 2 + cy AND c.x = sx * 2 + cx"),
    ),
    "s5_k12_shard_decode": (_decoded, with_sql("voxel", "SELECT * FROM voxel")),
    "k1_k13_brick_store": (_bricks, with_sql("voxel", "SELECT * FROM voxel WHERE z >= 3 AND z < 21 AND y >= 2 AND y < 30 AND x >= 2 AND x < 27")),
    "s7_k2_level_manifest": (
        _levels,
        with_sql("voxel", ", m AS (SELECT max(z) AS z, max(y) AS y, max(x) AS x FROM voxel), l AS (SELECT CAST(unnest(range(0, 4)) AS INT) AS level) SELECT level, CAST(1 << level AS INT) AS scale, " + ", ".join(f"CAST(({c} + (1 << level)) // (1 << level) AS INT) AS n{c}" for c in "zyx") + " FROM m, l"),
    ),
    "s10_zarr_metadata": (_zarr, with_sql("voxel", "SELECT " + ", ".join(f"CAST(max({c}) + 1 AS INT) AS n{c}" for c in "zyx") + ", 16 AS chunk, '|u1' AS dtype, 0 AS fill_value FROM voxel")),
    "s11_mirror_status": (
        _mirror,
        with_sql("voxel", ", r AS (SELECT unnest(range(0, 8)) AS k), g AS (SELECT CAST(a.k AS INT) AS cz, CAST(b.k AS INT) AS cy, CAST(e.k AS INT) AS cx FROM r a, r b, r e), c AS (SELECT DISTINCT z // 4 AS z, y // 4 AS y, x // 4 AS x FROM voxel) SELECT cz, cy, cx, CASE WHEN c.z IS NOT NULL THEN 'data' WHEN cz < 4 THEN 'absent' ELSE 'pending' END AS status, CASE WHEN c.z IS NOT NULL THEN 64 END AS bytes FROM g LEFT JOIN c ON c.z = cz AND c.y = cy AND c.x = cx"),
    ),
    "s14_tiff_surface": (_tiff, with_sql("sp", "SELECT 'seg' || seg_id AS name, j, i, x, y, z FROM sp")),
    "s15_k3_segment_store": (lambda s, d: _store(s, d)[0], with_sql("sp", "SELECT CAST(seg_id AS VARCHAR) AS seg_id, j, i, CASE WHEN seg_id % 2 = 0 THEN x ELSE x + 1000 END AS x, y, z FROM sp")),
    "s15_store_bounds": (
        lambda s, d: _store(s, d)[1].groupBy("seg_id").agg(F.count("*").alias("n_tiles"), F.min("sx_lo").alias("x_lo"), F.max("sx_hi").alias("x_hi")),
        with_sql("sp", ", q AS (SELECT seg_id, j, i, CASE WHEN seg_id % 2 = 0 THEN x ELSE x + 1000 END AS x FROM sp), t AS (SELECT DISTINCT seg_id, tj, ti FROM (SELECT seg_id, tj, unnest(range(greatest(i - 1, 0) // 4, i // 4 + 1)) AS ti FROM (SELECT seg_id, i, unnest(range(greatest(j - 1, 0) // 4, j // 4 + 1)) AS tj FROM q))) SELECT CAST(b.seg_id AS VARCHAR) AS seg_id, (SELECT count(*) FROM t WHERE t.seg_id = b.seg_id) AS n_tiles, min(x) AS x_lo, max(x) AS x_hi FROM q b GROUP BY b.seg_id"),
    ),
    "s17_paths_near": (
        lambda s, d: so.paths_near(_lines(s, d), 300.0, 30.0, 50.0),
        with_sql("sp", "SELECT DISTINCT a.seg_id * 10 + a.j AS path_id FROM sp a JOIN sp b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i = a.i + 1 WHERE " + " AND ".join(f"floor(greatest(a.{c}, b.{c}) / 64) >= {int((p - 50) // 64)} AND floor(least(a.{c}, b.{c}) / 64) <= {int((p + 50) // 64)}" for c, p in (("x", 300), ("y", 30)))),
    ),
    "s18_k15_axis_file": (_axis_file, with_sql("voxel", f", {AXIS} SELECT z, {_sqls('x', 'x')}, {_sqls('y', 'y')} FROM axis")),
    "s19_k16_transform_file": (
        _transform_file,
        with_sql("qp", "SELECT pt_id, way, " + ", ".join(_sqls(f"{r[0]!r}e0 * x + {r[1]!r}e0 * y + {r[2]!r}e0 * z + {r[3]!r}e0", f"m{c}") for c, r in zip(_AX, MATRIX, strict=True)) + " FROM qp, (VALUES ('pull'), ('published')) w(way)"),
    ),
    "s20_listing": (
        _listing,
        "SELECT 'object' AS kind, 's' || s_suppkey AS name, CAST(s_nationkey AS BIGINT) AS size FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT DISTINCT 'prefix', 'sub' || (s_suppkey // 25), NULL FROM supplier",
    ),
    "s21_p3_synthetic_volume": (
        _synthetic("sphere"),
        with_sql("voxel", ", g AS (SELECT unnest(range(0, 16)) AS k), p AS (SELECT CAST(k AS INT) AS k, (k + 0.5e0) / 16 * 2 - 1 AS p FROM g), m AS (SELECT z, y, x, CAST(floor(255 * (1 - r)) AS INT) AS v FROM (SELECT a.k AS z, b.k AS y, c.k AS x, sqrt(a.p * a.p + b.p * b.p + c.p * c.p) AS r FROM p a, p b, p c) WHERE r < 0.8 AND floor(255 * (1 - r)) > 0) SELECT z, y, x, m.v, voxel.v AS seen FROM m JOIN voxel USING (z, y, x)"),
    ),
    "s23_seeds_file": (
        _seeds,
        with_sql("sp", ", f AS (SELECT seg_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY j, i) AS n FROM sp) WHERE n = 1) SELECT CAST(row_number() OVER (ORDER BY seg_id) - 1 AS INT) AS k, x, y, z FROM f"),
    ),
    "k4_trace_save": (
        _trace_save,
        with_sql(
            "sp",
            ", q AS (SELECT *, i % 4 / 4e0 AS conf FROM sp WHERE i % 4 >= 2), o(dj, di) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)), t AS (SELECT DISTINCT p.seg_id, p.j, p.i FROM q p, o JOIN q n ON n.seg_id = p.seg_id AND n.j = p.j + dj AND n.i = p.i + di WHERE "
            + " + ".join(f"(n.{c} - p.{c}) * (n.{c} - p.{c})" for c in _AX)
            + " > 1225), u AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.seg_id = q.seg_id AND t.j = q.j AND t.i = q.i)) SELECT seg_id, CAST(j - min(j) OVER w AS INT) AS j, CAST(i - min(i) OVER w AS INT) AS i, x, y, z, conf, min(j) OVER w AS j0, min(i) OVER w AS i0 FROM u WINDOW w AS (PARTITION BY seg_id)",
        ),
    ),
    "k5_k6_label_bricks": (_label_bricks, with_sql("lab", "SELECT z, y, x, CAST(CASE WHEN z < 8 THEN cls % 7 + 1 ELSE cls END AS INT) AS cls FROM lab WHERE NOT (z < 8 AND y >= 24)")),
    "k7_k8_layer_files": (_layer_files, with_sql("voxel", "SELECT 0 AS seg_id, z AS layer, y AS j, x AS i, v FROM voxel")),
    "k9_report_json": (
        lambda s, d: sidecars.as_json(st.summary(samples(s, d)).drop("p50", "p95", "p99"), F.col("metric")),
        with_sql("sample", "SELECT metric, '{\"metric\":\"' || metric || '\",\"n\":' || count(*) || ',\"total\":' || CAST(sum(ns) AS BIGINT) || ',\"max\":' || max(ns) || '}' AS value FROM sample GROUP BY 1"),
    ),
    "k11_incomplete_bricks": (
        lambda s, d: volumes.incomplete(_brick_names(s, d)),
        with_sql("voxel", ", h AS (SELECT DISTINCT z // 4 AS z, y // 4 AS y, x // 4 AS x FROM voxel WHERE v = 250), b AS (SELECT min(z) AS za, max(z) AS zb, min(y) AS ya, max(y) AS yb, min(x) AS xa, max(x) AS xb FROM h), g AS (SELECT bz, by_, unnest(range(xa, xb + 1)) AS bx FROM (SELECT bz, xa, xb, unnest(range(ya, yb + 1)) AS by_ FROM (SELECT *, unnest(range(za, zb + 1)) AS bz FROM b))) SELECT CAST(bz AS INT) AS bz, CAST(by_ AS INT) AS by, CAST(bx AS INT) AS bx FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.z = bz AND h.y = by_ AND h.x = bx)"),
    ),
    "p1_user_sampler": (
        lambda s, d: query_points(s, d).select("pt_id", hooks.sampler(lambda z, y, x: 100 * z + 10 * y + x)("z", "y", "x").alias("value")),
        with_sql("qp", "SELECT pt_id, 100 * z + 10 * y + x AS value FROM qp"),
    ),
    "p2_user_table_function": (_table_function, with_sql("voxel", "SELECT * FROM voxel")),
    "p4_s22_user_model": (
        lambda s, d: segments.predicted_cells(volumes.bricks(voxels(s, d), 8), lambda a: a / 2, 8, 60),
        with_sql("voxel", ", p AS (SELECT z, y, x, CAST(floor(v / 255e0 / 2 * 255) AS INT) AS v FROM voxel) SELECT * FROM p WHERE v >= 60"),
    ),
    "e1_latest_request": (_latest, "SELECT user_id % 50 AS key, max(event_id) AS gen, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"),
    "e2_change_feed": (_changes, "SELECT event_id, user_id FROM events WHERE event_id > 700"),
    "e3_negative_cache": (_misses, _MISSES),
    "e4_fetches_in_flight": (_fetches, "SELECT DISTINCT user_id, event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events"),
    "e8_windowed_report": (
        _report,
        f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {_sqls('avg(ns)', 'mean', 4)}, max(ns) AS max FROM (SELECT ts, event_type, CAST(floor(value * 100) AS BIGINT) AS ns FROM events) GROUP BY 1, 2",
    ),
    "i7_populate": (
        _populated,
        with_sql(
            "sp",
            ", g AS (SELECT seg_id, j, i, i / 8e0 AS theta, j + i / 50e0 AS wind, z % 100 AS z FROM sp), r AS (SELECT *, "
            + " + ".join(f"{r!r}e0 * greatest(0, 1 - abs(z / 50 - {k}))" for k, r in enumerate(FIT["r0"]))
            + " + 0.5e0 * cos(theta) - 0.25e0 * sin(theta) + 0.125e0 * cos(2 * theta) + 0.0625e0 * sin(2 * theta) + 3 * wind AS rho FROM g) SELECT seg_id, j, i, "
            + f"{_sqls('5 + rho * cos(theta)', 'x')}, {_sqls('7 + rho * sin(theta)', 'y')}, {_sqls('z', 'z')} FROM r",
        ),
    ),
    "i14_larger_grid": (lambda s, d: so.shifted(surface_points(s, d), 2, 3), with_sql("sp", "SELECT seg_id, CAST(j + 2 AS INT) AS j, CAST(i + 3 AS INT) AS i, x, y, z FROM sp")),
    "w14_row_scan": (
        lambda s, d: su.rows_across(surface_points(s, d), "y", 41.0),
        with_sql("sp", ", r AS (SELECT seg_id, j FROM sp GROUP BY 1, 2 HAVING min(y) <= 41 AND max(y) >= 41) SELECT a.seg_id, a.j, a.i, a.y AS a, b.y AS b FROM sp a JOIN r ON r.seg_id = a.seg_id AND r.j = a.j JOIN sp b ON b.seg_id = a.seg_id AND b.j = a.j AND b.i = a.i + 1 WHERE (a.y <= 41) <> (b.y <= 41)"),
    ),
}
