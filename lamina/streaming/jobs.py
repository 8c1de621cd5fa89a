"""Structured Streaming forms of the request, change and cache behaviour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


def latest_requests(requests: DataFrame, key: str, gen: str, payload: list[str]) -> DataFrame:
    """The request of the highest generation of each key; later generations replace earlier ones."""
    return requests.groupBy(key).agg(F.max(F.struct(gen, *payload)).alias("r")).select(key, "r.*")


def changes_since(snapshots: DataFrame, gen: str, last_seen: int) -> DataFrame:
    """Rows of generations after the last one seen."""
    return snapshots.where(F.col(gen) > last_seen)


def deduplicated_fetches(fetches: DataFrame, keys: list[str], time: str, within: str = "10 minutes") -> DataFrame:
    """One fetch of each key while it may be in flight."""
    return fetches.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def sliding_report(samples: DataFrame, time: str, metric: str, value: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Number, mean and largest sample of each metric and window; late rows are counted while the watermark allows."""
    w = samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, every), metric)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), metric, "n", "mean", "max")


NEGATIVE = "key long, ts timestamp, verdict string"


def negative_cache(probes: DataFrame, ttl_ms: int, late: str = "10 minutes") -> DataFrame:
    """``verdict`` of each probe(key, ts, found): found, miss (remembered from now), cached (a miss within the time to live) or expired misses asked anew.

    ``found`` is true, false, or null for proven empty, which never expires. A key's probes in one batch
    are gone through in the order of time; probes later than ``late`` are dropped. What is remembered of
    a miss falls when the watermark has passed its time to live, asked again or not, so the state holds
    the misses of that time and the keys proven empty.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else None
        rows, out = pd.concat(list(batches)).sort_values("ts", kind="stable"), []
        for ts, found in zip(rows["ts"], rows["found"], strict=True):
            now = ts.value // 1_000_000
            if until is not None and (until < 0 or now < until):
                out.append((key[0], ts, "cached"))
            elif found is None or pd.isna(found):
                until = -1
                out.append((key[0], ts, "empty"))
            elif found:
                until = None
                out.append((key[0], ts, "found"))
            else:
                until = now + ttl_ms
                out.append((key[0], ts, "miss"))
        yield pd.DataFrame(out, columns=["key", "ts", "verdict"])
        if until is None:
            if state.exists:
                state.remove()
        else:
            state.update((until,))
            if until >= 0:
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    timed = probes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(step, NEGATIVE, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream's source has now, as a table in the folder ``path``: appended batch by batch, or the whole result written anew by each batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_now(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream's source has now, through a memory table; for tests and small reports."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
