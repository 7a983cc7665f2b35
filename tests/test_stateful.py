"""Streams whose state spans batches, against batches: gaps, projection, heartbeats, the log as a source; over several files, unordered, with a restart."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillspark.operators import timeseries as TS
from quillspark.streaming import folds, stateful as SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(frames, path):
    """One file each, in this order of times."""
    for k, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(f"{path}/{k:03}")
    return f"{path}/*"


def test_gaps_of_unordered_files(spark, tmp_path):
    rng = random.Random(4)
    base = 1_700_000_000
    events = [(u, base + rng.randrange(0, 200_000, 50)) for u in range(4) for _ in range(60)]
    frame = spark.createDataFrame(events, "user_id long, at long").select("user_id", F.timestamp_seconds("at").alias("ts"))
    want = rows(TS.gaps(frame, "ts", 600.0, ["user_id"]).select("user_id", "before", "after", "seconds", "missing"))
    rng.shuffle(events)
    parts = [spark.createDataFrame(events[k::3], "user_id long, at long").select("user_id", F.timestamp_seconds("at").alias("ts")) for k in range(3)]
    tick = spark.createDataFrame([(-1, base + 900_000)], "user_id long, at long").select("user_id", F.timestamp_seconds("at").alias("ts"))
    own = SF.stateful(spark)
    at, schema = str(tmp_path / "e"), frame.schema
    for k, part in enumerate([*parts, tick]):  # the stream stops and starts again after each file
        part.coalesce(1).write.mode("append").parquet(f"{at}/{k:03}")
        found = folds.appended(SF.gap_stream(folds.read_stream(own, f"{at}/*", schema), "user_id", "ts", 600.0, "3 days"), str(tmp_path / "out"))
        assert k == 3 or rows(found) == []
    assert rows(found) == want and len(want) > 50


def test_projection_is_written_behind(spark, tmp_path):
    kinds = ["step_started", "status_changed", "noted", "step_completed"]
    log = [(p, s, kinds[(s * 7 + p) % 4] if p else "noted", f"x{s}") for p in range(5) for s in range(1, 14 + p)]
    schema = "pipeline_id long, seq long, type string, status string"
    random.Random(3).shuffle(log)
    frame = spark.createDataFrame(log, schema)
    path = files([spark.createDataFrame(log[k::3], schema) for k in range(3)], str(tmp_path / "l"))
    own = SF.stateful(spark, empty_batches=False)
    written = folds.appended(SF.projection_stream(folds.read_stream(own, path, frame.schema), interval=10**7), str(tmp_path / "out")).cache()
    by_count = [r for r in written.collect() if r["pipeline_id"] == 0]
    assert [r["why"] for r in by_count] == ["count", "count"] and sorted(r["n"] for r in by_count) == [5, 10]  # 13 events, no mandatory one: three are not written
    assert {r["why"] for r in written.collect() if r["pipeline_id"]} == {"count", "mandatory"}
    want = {}
    for p, s, t, x in sorted(log):
        last, status = want.get(p, (0, "pending"))
        want[p] = (s, x if t == "status_changed" else status)
    assert {r["pipeline_id"]: (r["last_seq"], r["status"]) for r in SF.projected(written, frame).collect()} == want
    stale = spark.createDataFrame([(1, 3, "old", 99, "count")], written.schema)
    assert rows(SF.projected(written.union(stale), frame)) == rows(SF.projected(written, frame))


def test_projection_timer(spark, tmp_path):
    schema = "pipeline_id long, seq long, type string, status string"
    at, own = str(tmp_path / "l"), SF.stateful(spark, empty_batches=False)
    for k in range(2):  # the second batch comes after the interval of the first
        spark.createDataFrame([(k, 1, "noted", "a")], schema).coalesce(1).write.mode("append").parquet(f"{at}/{k}")
        found = folds.appended(SF.projection_stream(folds.read_stream(own, f"{at}/*", spark.createDataFrame([], schema).schema), interval=1), str(tmp_path / "out"))
    assert (0, 1, "pending", 1, "time") in rows(found)


def test_heartbeats_of_two_streams(spark, tmp_path):
    base, lease = 1_700_000_000, 100
    claims = [(1, 7, base), (2, 8, base + 50), (3, 7, base + 500)]
    beats = [(1, 7, base + 10), (2, 7, base + 100), (3, 7, base + 101), (4, 8, base + 40), (5, 8, base + 60), (6, 9, base), (7, 7, base + 550)]
    far = base + 10**6
    cs, bs = "claim_id long, task_id long, at long", "beat_id long, task_id long, at long"
    c = files([spark.createDataFrame(claims[k::2], cs) for k in range(2)] + [spark.createDataFrame([(-1, -1, far)], cs)], str(tmp_path / "c"))
    b = files([spark.createDataFrame(beats[k::2], bs) for k in (1, 0)] + [spark.createDataFrame([(-1, -2, far)], bs)], str(tmp_path / "b"))
    stream = SF.beat_stream(folds.read_stream(spark, c, spark.createDataFrame([], cs).schema), folds.read_stream(spark, b, spark.createDataFrame([], bs).schema), "1 hour", lease)
    found = {r["beat_id"]: r["claim_id"] for r in folds.appended(stream, str(tmp_path / "out")).collect() if r["beat_id"] > 0}
    assert found == {1: 1, 2: 1, 3: None, 4: None, 5: 2, 6: None, 7: 3}


def test_log_lines_come_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda k: json.dumps({"seq": k, "type": "t", "payload": {"k": k}})
    read = lambda: [r["seq"] for r in folds.appended(SF.log_stream(spark, str(log)), str(tmp_path / "out")).orderBy("seq").collect()]
    (log / "a.jsonl").write_text(line(1) + "\n" + line(2) + "\n" + line(3)[:9])
    assert read() == [1, 2]
    assert read() == [1, 2]
    (log / "a.jsonl").write_text(line(1) + "\n" + line(2) + "\n" + line(3) + "\n\n" + line(4))
    (log / "b.jsonl").write_text(line(9) + "\n")
    assert read() == [1, 2, 3, 9]
    (log / "a.jsonl").write_text(line(1) + "\n" + line(2) + "\n" + line(3) + "\n\n" + line(4) + "\n" + '{"seq": 5, "ty\n' + line(6) + "\n")
    with pytest.raises(StreamingQueryException, match="TornLine"):
        read()
