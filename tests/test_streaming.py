"""Streams over files, run until the source is exhausted."""

import datetime as dt

from pyspark.sql import functions as F

from lamina.streaming import jobs


def at(s):
    return dt.datetime(2026, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)


def stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}")


def test_latest_request_wins(spark, tmp_path):
    s = stream(spark, tmp_path / "in", [[("a", 1, 10), ("b", 1, 20)], [("a", 3, 30), ("a", 2, 40)]], "k string, gen int, what int")
    out = jobs.run_now(jobs.latest_requests(s, "k", "gen", ["what"]), "latest", f"file://{tmp_path}/c", "complete")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 3, 30), ("b", 1, 20)]


def test_change_feed(spark, tmp_path):
    s = stream(spark, tmp_path / "in", [[(1, 5)], [(2, 6), (3, 7)]], "gen int, v int")
    assert sorted(r["gen"] for r in jobs.run_now(jobs.changes_since(s, "gen", 1), "changes", f"file://{tmp_path}/c").collect()) == [2, 3]


def test_fetches_in_flight_are_deduplicated(spark, tmp_path):
    s = stream(spark, tmp_path / "in", [[(1, at(0)), (1, at(5)), (2, at(6))], [(1, at(9))]], "cell int, ts timestamp")
    assert sorted(r["cell"] for r in jobs.run_now(jobs.deduplicated_fetches(s, ["cell"], "ts"), "fetches", f"file://{tmp_path}/c").collect()) == [1, 2]


def test_negative_cache(spark, tmp_path):
    s = stream(spark, tmp_path / "in", [[(1, at(0), False), (2, at(0), None)], [(1, at(1), True), (1, at(20), True), (2, at(99), True)]], "key long, ts timestamp, found boolean")
    out = jobs.run_now(jobs.negative_cache(s, 10_000), "negative", f"file://{tmp_path}/c")
    assert [r["verdict"] for r in out.orderBy("key", "ts").collect()] == ["miss", "cached", "found", "empty", "cached"]


def test_what_is_remembered_of_a_miss_falls(spark, tmp_path):
    """Key 1 isn't asked again, and its state goes when time has passed it; key 3, proven empty, stays."""
    s = stream(spark, tmp_path / "in", [[(1, at(0), False), (3, at(0), None)], [(2, at(100), False)], [(2, at(200), False)], [(2, at(300), False), (3, at(300), True)]], "key long, ts timestamp, found boolean")
    q = jobs.negative_cache(s, 10_000, "1 second").writeStream.format("memory").queryName("falls").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # keys 2 and 3
    assert [(r["key"], r["verdict"]) for r in spark.table("falls").orderBy("key", "ts").collect()] == [(1, "miss"), (2, "miss"), (2, "miss"), (2, "miss"), (3, "empty"), (3, "cached")]


def test_report_over_events(spark, tmp_path):
    folder = "/root/testdata/sf0.001/events.parquet"
    s = jobs.event_stream(spark, folder)
    out = jobs.run_now(jobs.sliding_report(s, "ts", "event_type", "value", "1 day", "3650 days"), "report", f"file://{tmp_path}/c", "complete")
    want = spark.read.parquet(folder).groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((str(r["start"]), r["event_type"], r["n"]) for r in out.collect()) == sorted((str(r["start"]), r["event_type"], r["n"]) for r in want.collect())
