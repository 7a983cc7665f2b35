"""Structured Streaming forms of the folds and time-series operators; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.queues import ATTEMPTS, LEASE, STALE
from quillspark.session import reach_workers, saved

#: Folders of a table that is updated by key.
BUCKETS = 16


def read_stream(spark: SparkSession, path: str, schema, files: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def windowed(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "40 days", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by tumbling window and keys, with a watermark."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "2 hours", late: str = "40 days", key: str = "user_id") -> DataFrame:
    """Activity without a gap, per key."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.session_window("_t", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "40 days") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


LEASE_OUT = "task_id long, claims long, failures long, last_beat long, state string"
LEASE_STATE = "claims long, failures long, last_beat long, claim long, ended long, done long"


def _lease(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    claims, failures, beat, claim, ended, done = state.get if state.exists else (0, 0, -1, -1, -1, 0)
    if state.hasTimedOut:  # no sign of life within the lease: reaped
        failures += int(claim > ended)
        ended = max(ended, claim)
    for rows in batches:
        for at, kind in sorted(zip(rows["at"], rows["kind"])):
            at = int(at)
            if kind == "claim":
                claims, claim, beat = claims + 1, max(claim, at), max(beat, at)
            elif kind == "heartbeat":
                beat = max(beat, at)
            elif kind in ("fail", "complete"):
                ended = max(ended, at)
                failures += kind == "fail"
                done += kind == "complete"
    live = claim >= 0 and ended < claim
    state.update((claims, failures, beat, claim, ended, done))
    if live and state.getCurrentWatermarkMs() < (max(beat, claim) + STALE) * 1000:
        state.setTimeoutTimestamp(min(beat + STALE, claim + LEASE) * 1000 + 1)
    name = "done" if done else "dead_letter" if failures >= ATTEMPTS else "running" if live else "ready"
    yield pd.DataFrame([(key[0], claims, failures, beat, name)], columns=[f.split()[0] for f in LEASE_OUT.split(", ")])


def lease_stream(events: DataFrame, late: str = "40 days") -> DataFrame:
    """Lease state of every task from events (task_id, at, kind), with event-time timeouts."""
    reach_workers(events.sparkSession)
    rows = events.withColumn("_t", F.timestamp_seconds("at")).withWatermark("_t", late)
    return rows.groupBy("task_id").applyInPandasWithState(_lease, LEASE_OUT, LEASE_STATE, "update", GroupStateTimeout.EventTimeTimeout)


FOLD_OUT = "pipeline_id long, last_seq long, status string"


def _fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, at, status = state.get if state.exists else (-1, -1, "pending")
    for rows in batches:
        last = max(last, int(rows["seq"].max()))
        said = rows[rows["type"] == "status_changed"]
        if len(said) and int(said["seq"].max()) > at:
            top = said.loc[said["seq"].idxmax()]
            at, status = int(top["seq"]), top["status"]
    state.update((last, at, status))
    yield pd.DataFrame([(key[0], last, status)], columns=["pipeline_id", "last_seq", "status"])


def fold_stream(events: DataFrame) -> DataFrame:
    """Latest sequence and status of every pipeline; events may come out of order."""
    reach_workers(events.sparkSession)
    return events.groupBy("pipeline_id").applyInPandasWithState(_fold, FOLD_OUT, "last long, at long, status string", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, keys: tuple[str, ...], order: str, buckets: int = BUCKETS):
    """For `foreachBatch`: a table of the last row of every key by `order`, in Parquet folders by bucket of the key. A batch rewrites the buckets that it touches and no
    others, and gives the same when it is written again. Returns the function; `upserted` reads the table."""

    def write(batch: DataFrame, version: int) -> None:
        spark, names = batch.sparkSession, batch.columns
        last = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct(*names, "_b"), F.struct(order, "_new")).alias("_r")).select("_r.*")
        fresh = saved(last(batch.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("_new", F.lit(1))))
        touched = [r["_b"] for r in fresh.select("_b").distinct().collect()]  # at most `buckets`
        if version:
            old = spark.read.schema(fresh.schema).parquet(path).where(F.col("_b").isin(touched)).select(*names, "_b", F.lit(0).alias("_new"))
            fresh = saved(last(old.unionByName(fresh.withColumn("_new", F.lit(1)))))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_b").parquet(path)

    return write


def upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_b")


def replace_sink(path: str):
    """For `foreachBatch` in complete mode: the whole result, in place of the one before."""

    def write(batch: DataFrame, version: int) -> None:
        saved(batch).write.mode("overwrite").parquet(path)

    return write


def written(stream: DataFrame, sink, mode: str, folder: str) -> None:
    """All that is there through a function for batches, with the offsets in a folder that survives the driver."""
    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """All that is there, appended to Parquet files."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start(f"{folder}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is there, as a table in memory; for tests and small states."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
