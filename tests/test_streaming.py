"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import eventlog as E
from quillspark.operators import queues as Q
from quillspark.streaming import folds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in three files."""
    path = str(tmp_path_factory.mktemp("events") / "e")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(path)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_windows(spark, parts):
    batch = spark.read.parquet(parts)
    stream = folds.read_stream(spark, parts, batch.schema)
    assert rows(folds.run_available(folds.windowed(stream), "w", "complete")) == rows(folds.windowed(batch))


def test_sessions(spark, parts):
    batch = spark.read.parquet(parts)
    stream = folds.read_stream(spark, parts, batch.schema)
    assert rows(folds.run_available(folds.sessions(stream), "s", "complete")) == rows(folds.sessions(batch))


def test_deduplication(spark, parts):
    batch = spark.read.parquet(parts)
    stream = folds.read_stream(spark, parts, batch.schema, files=3)
    assert folds.run_available(folds.deduplicated(stream), "d", "append").select("event_id").count() == batch.select("event_id").distinct().count()


def test_leases(spark, tmp_path):
    ev = [(1, 0, "claim"), (1, 100, "heartbeat"), (2, 0, "claim"), (2, 50, "complete"), (3, 0, "claim"), (3, 10, "fail"), (3, 20, "claim"), (3, 30, "fail"), (3, 40, "claim"), (3, 50, "fail"), (4, 60, "claim")]
    frame = spark.createDataFrame(ev, "task_id long, at long, kind string").withColumn("at", F.col("at") + 1_700_000_000)
    frame.repartition(2).write.parquet(str(tmp_path / "l"))
    found = folds.run_available(folds.lease_stream(folds.read_stream(spark, str(tmp_path / "l"), frame.schema)), "l", "update")
    last = {r["task_id"]: (r["claims"], r["failures"], r["state"]) for r in E.latest(found.withColumn("_o", F.col("claims") * 100 + F.col("failures") * 10 + (F.col("state") == "done").cast("int")), "task_id", "_o").collect()}
    want = {r["task_id"]: (r["claims"], r["failures"], r["state"]) for r in Q.lease_states(frame, F.lit(1_700_000_100)).collect()}
    assert last == want


def test_fold(spark, tmp_path):
    ev = [(p, s, "status_changed" if s % 3 == 0 else "step_started", f"s{s}", f"x{s}") for p in range(4) for s in range(1, 12 + p)]
    frame = spark.createDataFrame(ev, "pipeline_id long, seq long, type string, step string, status string")
    frame.repartition(3).write.parquet(str(tmp_path / "f"))
    found = folds.run_available(folds.fold_stream(folds.read_stream(spark, str(tmp_path / "f"), frame.schema)), "f", "update")
    last = {r["pipeline_id"]: (r["last_seq"], r["status"]) for r in E.latest(found.withColumn("_s", F.length("status") * 100 + F.substring("status", 2, 9).try_cast("int")), "pipeline_id", "last_seq").collect()}
    want = {r["pipeline_id"]: (r["last_seq"], r["status"]) for r in E.pipeline_states(frame).collect()}
    assert {k: v[0] for k, v in last.items()} == {k: v[0] for k, v in want.items()}
    final = {}
    for r in found.collect():
        if r["status"].startswith("x"):
            final[r["pipeline_id"]] = max(final.get(r["pipeline_id"], -1), int(r["status"][1:]))
    assert {k: f"x{v}" for k, v in final.items()} == {k: v[1] for k, v in want.items()}


def test_upserts(spark, tmp_path):
    frame = spark.createDataFrame([(k % 5, k, f"v{k}") for k in range(20)], "k long, at long, v string")
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = folds.read_stream(spark, str(tmp_path / "in"), frame.schema)
    out = str(tmp_path / "out")
    folds.written(stream, folds.upsert_sink(out, ("k",), "at", 3), "append", str(tmp_path / "w"))
    want = [(k, 15 + k, f"v{15 + k}") for k in range(5)]
    assert rows(folds.upserted(spark, out).select("k", "at", "v")) == want
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    sink = folds.upsert_sink(out, ("k",), "at", 3)
    one = spark.createDataFrame([(3, 99, "new"), (3, 1, "old")], frame.schema)
    for _ in range(2):  # a batch that is written again changes nothing
        sink(one, 7)
        assert rows(folds.upserted(spark, out).select("k", "at", "v")) == sorted([w for w in want if w[0] != 3] + [(3, 99, "new")])
    assert sum(p in before and p.stat().st_mtime_ns == before[p] for p in (tmp_path / "out").rglob("*.parquet")) > 0
