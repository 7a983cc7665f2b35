"""Streams over the events table, run to the end of what is there and written to tables, which the queries return."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.registry import register
from quillspark.plans.stat_queries import _log, lease_events, turn_log
from quillspark.session import scratch, table
from quillspark.streaming import folds, stateful


#: Batches of a table: each one rewrites what it touches of the result, so their number does not grow with the files.
BATCHES = 8


def source(spark, sf_dir, name="events"):
    """A table as a stream of files; the pattern also matches one that is a single file."""
    rows = table(spark, sf_dir, name)
    return folds.read_stream(spark, f"{sf_dir}/{name}.parquet*", rows.schema, files=-(-len(rows.inputFiles()) // BATCHES))


@register("stream_window", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_window(spark, sf_dir):
    """Changed windows go to a table by key, of which the last state is read: a projection behind the log."""
    at = scratch(spark, "windows")
    folds.written(folds.windowed(source(spark, sf_dir)), folds.upsert_sink(f"{at}/rows", ("start", "event_type"), "n"), "update", at)
    return folds.upserted(spark, f"{at}/rows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_session", "WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g")
def stream_session(spark, sf_dir):
    at = scratch(spark, "sessions")
    folds.written(folds.sessions(source(spark, sf_dir)), folds.replace_sink(f"{at}/rows"), "complete", at)
    return spark.read.parquet(f"{at}/rows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_dedup", "SELECT event_id, any_value(event_type) AS event_type FROM events GROUP BY 1")
def stream_dedup(spark, sf_dir):
    """Every event comes twice, in two streams."""
    twice = source(spark, sf_dir).union(source(spark, sf_dir))
    return folds.appended(folds.deduplicated(twice).select("event_id", "event_type"), scratch(spark, "distinct"))


@register("stream_totals", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_totals(spark, sf_dir):
    at = scratch(spark, "totals")
    totals = source(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    folds.written(totals, folds.upsert_sink(f"{at}/rows", ("user_id",), "n"), "update", at)
    return folds.upserted(spark, f"{at}/rows")


@register("stream_states", f"WITH {_log} SELECT pipeline_id, max(seq) AS last_seq, coalesce(arg_max(status, seq) FILTER (WHERE type = 'status_changed'), 'pending') AS status FROM lg GROUP BY 1")
def stream_states(spark, sf_dir):
    """The fold of the log with state of its own, its last rows by key."""
    at = scratch(spark, "states")
    log = folds.fold_stream(turn_log(spark, sf_dir, source(spark, sf_dir, "conversations")))
    folds.written(log, folds.upsert_sink(f"{at}/rows", ("pipeline_id",), "last_seq"), "update", at)
    return folds.upserted(spark, f"{at}/rows")


@register("stream_claims", "WITH e AS (SELECT user_id * 10 + event_id % 10 AS task_id, ['claim', 'heartbeat', 'heartbeat', 'fail', 'complete'][CAST(event_id % 5 + 1 AS INT)] AS kind FROM events) SELECT task_id, count(*) FILTER (WHERE kind = 'claim') AS claims FROM e GROUP BY 1")
def stream_claims(spark, sf_dir):
    """Leases of tasks with timeouts in event time."""
    at = scratch(spark, "leases")
    leases = folds.lease_stream(lease_events(spark, sf_dir, source(spark, sf_dir)))
    rows = leases.withColumn("_seen", F.col("claims") * 1_000_000 + F.col("failures") * 1000 + (F.col("state") == "done").cast("int"))
    folds.written(rows, folds.upsert_sink(f"{at}/rows", ("task_id",), "_seen"), "update", at)
    return folds.upserted(spark, f"{at}/rows").select("task_id", "claims")


def in_files(df, at, parts):
    """A table as a stream of several files, dealt by hash, so times are unordered across them."""
    df.repartition(parts, F.xxhash64(*df.columns)).write.parquet(at)
    return at


def ticked(df, at, parts, tick):
    """The same with a last file of one row, whose time passes all others."""
    in_files(df, f"{at}/0", parts)
    tick.coalesce(1).write.parquet(f"{at}/1")
    return f"{at}/*"


@register("stream_gaps", "WITH g AS (SELECT user_id, ts AS after, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT *, CAST(epoch_us(after) - epoch_us(before) AS DOUBLE) / 1000000 AS seconds FROM g) SELECT user_id, before, after, round(seconds, 3) AS seconds, CAST(floor(seconds / 3600) - 1 AS BIGINT) AS missing FROM s WHERE seconds > 5400")
def stream_gaps(spark, sf_dir):
    """Gaps of every user from events in several files without order, held back until the watermark has passed them."""
    at = scratch(spark, "gaps")
    own = stateful.stateful(spark)
    events = table(own, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    tick = events.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"))
    stream = folds.read_stream(own, ticked(events, f"{at}/in", 3, tick), events.schema, files=2)
    found = folds.appended(stateful.gap_stream(stream, "user_id", "ts", 3600.0, "90 days"), at)
    return found.select("user_id", F.col("before").cast("timestamp_ntz").alias("before"), F.col("after").cast("timestamp_ntz").alias("after"), F.round("seconds", 3).alias("seconds"), "missing")


@register("stream_projection", f"WITH {_log} SELECT pipeline_id, max(seq) AS last_seq, coalesce(arg_max(status, seq) FILTER (WHERE type = 'status_changed'), 'pending') AS status FROM lg GROUP BY 1")
def stream_projection(spark, sf_dir):
    """The projection written behind a log that comes in several files without order; what it lacks is folded anew."""
    at = scratch(spark, "projection")
    own = stateful.stateful(spark, empty_batches=False)
    log = turn_log(own, sf_dir)
    written = folds.appended(stateful.projection_stream(folds.read_stream(own, in_files(log, f"{at}/in", 3), log.schema)), at)
    return stateful.projected(written, log)


_claims = "e AS (SELECT event_id, user_id * 10 + event_id % 10 AS task_id, epoch(date_trunc('second', ts))::BIGINT AS tm, event_id % 5 = 0 AS claim, event_id % 5 IN (1, 2) AS beat FROM events)"


@register("stream_heartbeats", f"WITH {_claims} SELECT event_id AS beat_id, task_id, EXISTS (SELECT 1 FROM e c WHERE c.claim AND c.task_id = b.task_id AND c.tm BETWEEN b.tm - 7200 AND b.tm) AS accepted FROM e b WHERE beat")
def stream_heartbeats(spark, sf_dir):
    """Heartbeats and claims as two streams: a beat is accepted if its task was claimed at most a lease before, else it is of a worker whose lease is over."""
    at = scratch(spark, "heartbeats")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 10 + F.col("event_id") % 10).alias("task_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    end = lambda df, k: df.agg(F.lit(None).cast("long"), F.lit(k).cast("long"), F.max("at") + 100 * 86400).toDF(*df.columns)
    claims = e.where("event_id % 5 = 0").withColumnRenamed("event_id", "claim_id")
    beats = e.where("event_id % 5 IN (1, 2)").withColumnRenamed("event_id", "beat_id")
    streams = [folds.read_stream(spark, ticked(df, f"{at}/{n}", 2, end(e, k).toDF(*df.columns)), df.schema, files=2) for n, k, df in (("claims", -1, claims), ("beats", -2, beats))]
    found = folds.appended(stateful.beat_stream(*streams, "90 days"), at).where("beat_id IS NOT NULL")
    return found.groupBy("beat_id", "task_id").agg(F.max(F.col("claim_id").isNotNull()).alias("accepted"))


@register("stream_log", "SELECT turn AS seq, role AS type, len(coalesce(text, '')) AS chars, conv_id AS conv FROM conversations")
def stream_log(spark, sf_dir):
    """Turns written as lines of JSON and read by byte offsets."""
    at = scratch(spark, "log")
    t = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("turn").alias("seq"), F.col("role").alias("type"), F.struct("conv_id", F.length(F.coalesce("text", F.lit(""))).alias("chars")).alias("payload")))
    t.select(line.alias("value")).write.text(f"{at}/in")
    found = folds.appended(stateful.log_stream(spark, f"{at}/in"), at)
    field = lambda n: F.get_json_object("payload", f"$.{n}").cast("long").alias("conv" if n == "conv_id" else n)
    return found.select("seq", "type", field("chars"), field("conv_id"))
