"""Stateful streams with timers, joins of two streams, and the log as a source.

* `gap_stream` holds events back until the watermark has passed them, so late and unordered ones within the watermark give the gaps of the sorted series.
* `projection_stream` is the write-behind projection: the folded state of a pipeline is written at a mandatory event, after EVERY events, or INTERVAL milliseconds after the first unwritten one, by a timer in processing time.
* `beat_stream` joins heartbeats with the claims that may carry them; what no claim carries comes out once both watermarks have passed its time.
* `LogSource` reads files of JSON lines by byte offsets.

The first two need `spark.sql.streaming.stateStore.providerClass` to be the RocksDB provider: see `stateful`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators.queues import LEASE
from quillspark.session import reach_workers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# When the projection is written.
EVERY, INTERVAL = 5, 5000
MANDATORY = ("step_completed", "step_failed", "step_paused")
# End of fixed values.


def stateful(spark: SparkSession, empty_batches: bool = True) -> SparkSession:
    """A session of its own on the same context, with the state store that timers need. A stream with timers in processing time that is to end when all is read takes no empty batches: it would wait for
    timers for ever."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(empty_batches).lower())
    reach_workers(own)
    return own


class Gaps(StatefulProcessor):
    """Per key: times not yet passed by the watermark, and the last one that was. The timer is that of the earliest time; when it expires, all that has passed is done, and the next one is set."""

    def __init__(self, expected: float):
        self.expected = expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [int(x) for r in rows for x in r["at"]]
        if fresh:
            self.waiting.appendList([(x,) for x in fresh])
            self.handle.registerTimer(-(-min(fresh) // 1000))
        yield pd.DataFrame({"key": [], "before": [], "after": []}).astype({"key": "int64", "before": "int64", "after": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(x[0] for x in self.waiting.get())
        done = [x for x in waiting if x <= passed]
        rest = [x for x in waiting if x > passed]
        before = self.last.get()[0] if done and self.last.exists() else None
        out = []
        for at in done:
            if before is not None and at - before > 1.5e6 * self.expected:
                out.append((key[0], before, at))
            before = at
        if done:
            self.last.update((before,))
            self.waiting.clear()
            if rest:
                self.waiting.put([(x,) for x in rest])
                self.handle.registerTimer(-(-rest[0] // 1000))
        yield pd.DataFrame(out, columns=["key", "before", "after"]).astype({"key": "int64", "before": "int64", "after": "int64"})

    def close(self) -> None:
        pass


def gap_stream(events: DataFrame, key: str, time: str, expected: float, late: str) -> DataFrame:
    """key, before, after, seconds, missing, as `timeseries.gaps` gives them for the whole series. A gap comes out when the watermark has passed its end."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("_t")).where("_t IS NOT NULL").withColumn("at", F.unix_micros("_t")).withWatermark("_t", late)
    found = rows.groupBy("key").transformWithStateInPandas(Gaps(expected), "key long, before long, after long", "Append", "EventTime")
    seconds = (F.col("after") - F.col("before")) / 1e6
    out = found.select(F.col("key").alias(key), F.timestamp_micros("before").alias("before"), F.timestamp_micros("after").alias("after"), seconds.alias("seconds"))
    return out.withColumn("missing", (F.floor(F.col("seconds") / expected) - 1).cast("long"))


class Projection(StatefulProcessor):
    """Per pipeline: the fold so far, how many events it holds, and how many of them are not written."""

    def __init__(self, every: int, interval: int):
        self.every, self.interval = every, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ver long, at long, status string, n long, unwritten long")

    def _out(self, key, state, why: str) -> pd.DataFrame:
        return pd.DataFrame({"pipeline_id": [key[0]], "ver": [state[0]], "status": [state[2]], "n": [state[3]], "why": [why]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.state.get()) if self.state.exists() else [-1, -1, "pending", 0, 0]
        waiting = state[4] > 0
        events = sorted((int(s), t, x) for r in rows for s, t, x in zip(r["seq"], r["type"], r["status"]))
        for seq, kind, status in events:  # an older event than those applied changes the status only if no later one said it
            if kind == "status_changed" and seq > state[1]:
                state[1:3] = seq, status
            state[0] = max(state[0], seq)
            state[3:] = state[3] + 1, state[4] + 1
            if kind in MANDATORY or state[4] >= self.every:
                yield self._out(key, state, "mandatory" if kind in MANDATORY else "count")
                state[4] = 0
        if state[4] and not waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval)
        self.state.update(tuple(state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.state.get())
        if state[4]:
            yield self._out(key, state, "time")
            state[4] = 0
            self.state.update(tuple(state))

    def close(self) -> None:
        pass


def projection_stream(events: DataFrame, every: int = EVERY, interval: int = INTERVAL) -> DataFrame:
    """pipeline_id, ver, status, n (events folded), why: what is written behind the log of (pipeline_id, seq, type, status)."""
    rows = events.select("pipeline_id", "seq", "type", "status")
    return rows.groupBy("pipeline_id").transformWithStateInPandas(Projection(every, interval), "pipeline_id long, ver long, status string, n long, why string", "Append", "ProcessingTime")


def projected(written: DataFrame, log: DataFrame) -> DataFrame:
    """pipeline_id, last_seq, status: what was written last where it is of the log's last version and holds all its events, else the fold of the log anew. Older versions never count."""
    newest = written.groupBy("pipeline_id").agg(F.max_by(F.struct("ver", "status", "n"), F.struct("ver", "n")).alias("w"))
    said = F.when(F.col("type") == "status_changed", F.col("seq"))
    folded = log.groupBy("pipeline_id").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max_by("status", said), F.lit("pending")).alias("replayed"))
    fresh = (F.col("w.ver") == F.col("last_seq")) & (F.col("w.n") == F.col("n"))
    return folded.join(newest, "pipeline_id", "left").select("pipeline_id", "last_seq", F.when(fresh, F.col("w.status")).otherwise(F.col("replayed")).alias("status"))


def beat_stream(claims: DataFrame, beats: DataFrame, late: str, lease: int = LEASE) -> DataFrame:
    """beat_id, task_id, claim_id: heartbeats (beat_id, task_id, at) with the claims (claim_id, task_id, at; seconds) that came at most a lease before, or none: of a worker whose lease is over."""
    left = beats.select("beat_id", "task_id", F.timestamp_seconds("at").alias("beat_at")).withWatermark("beat_at", late)
    right = claims.select("claim_id", F.col("task_id").alias("_task"), F.timestamp_seconds("at").alias("claim_at")).withWatermark("claim_at", late)
    carried = (F.col("task_id") == F.col("_task")) & (F.col("claim_at") <= F.col("beat_at")) & (F.col("beat_at") <= F.col("claim_at") + F.expr(f"INTERVAL {lease} SECONDS"))
    return left.join(right, carried, "left").select("beat_id", "task_id", "claim_id")


class TornLine(ValueError):
    """A line before the last one that is no JSON."""


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class LogReader(DataSourceStreamReader):
    """Offsets are bytes by file. What follows the last line end of a file is held back: it may still be being written."""

    def __init__(self, folder: str):
        self.folder = folder

    def _files(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return store, sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, files = self._files()
        return {p: end for p, size in files if (end := self._last_line(store, p, size))}

    def _last_line(self, store, path: str, size: int) -> int:
        """The byte behind the last line end, found from behind."""
        with store.open_input_file(path) as f:
            at = size
            while at:
                lo = max(0, at - 65536)
                f.seek(lo)
                k = f.read(at - lo).rfind(b"\n")
                if k >= 0:
                    return lo + k + 1
                at = lo
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Stretch(p, int(start.get(p, 0)), int(e)) for p, e in sorted(end.items()) if int(e) > int(start.get(p, 0))]

    def read(self, partition: Stretch):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as f:
            f.seek(partition.start)
            at, rest = partition.start, b""
            while at < partition.end:
                piece = f.read(min(1 << 20, partition.end - at))
                at += len(piece)
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    if line.strip():
                        try:
                            row = json.loads(line)
                            yield int(row["seq"]), row.get("type"), json.dumps(row.get("payload"), sort_keys=True), partition.path
                        except (ValueError, KeyError, TypeError) as e:
                            raise TornLine(f"{partition.path}: {line[:80]!r}") from e

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """`readStream.format("jsonlog").load(folder)`: seq, type, payload (JSON), file."""

    @classmethod
    def name(cls) -> str:
        return "jsonlog"

    def schema(self) -> str:
        return "seq long, type string, payload string, file string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"])


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the log files in a folder, as they are appended."""
    reach_workers(spark)
    spark.dataSource.register(LogSource)
    return spark.readStream.format("jsonlog").load(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
