"""Event logs: folds, differences, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pipeline_states(events: DataFrame) -> DataFrame:
    """Latest status, steps done, failed and open for each pipeline from events (pipeline_id, seq, type, step, status).

    One row a step first, so a long log is combined on the map side; unknown types change nothing.
    """
    kinds = ("step_started", "step_completed", "step_failed", "step_paused", "interrupted")
    steps = events.where(F.col("type").isin(*kinds)).groupBy("pipeline_id", "step").agg(F.max_by("type", "seq").alias("_t"), F.sum((F.col("type") == "step_started").cast("int")).alias("_a"))
    n = lambda *k: F.sum(F.col("_t").isin(*k).cast("int"))
    per = steps.groupBy("pipeline_id").agg(n("step_completed").alias("completed"), n("step_failed", "interrupted").alias("failed"), n("step_started").alias("open"), F.sum("_a").alias("attempts"))
    last = events.groupBy("pipeline_id").agg(F.max("seq").alias("last_seq"), F.max_by(F.when(F.col("type") == "status_changed", F.col("status")), F.when(F.col("type") == "status_changed", F.col("seq"))).alias("status"))
    return last.join(per, "pipeline_id", "left").select("pipeline_id", "last_seq", F.coalesce("status", F.lit("pending")).alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("completed", "failed", "open", "attempts")])


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_l")).select(key, "_l.*")


def changes(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return events.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(value)))


def sequence_gaps(events: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """key, before, after where the sequence is not contiguous."""
    before = F.lag(order).over(W.partitionBy(key).orderBy(order))
    return events.select(key, before.alias("before"), F.col(order).alias("after")).where("after <> before + 1")


def interrupted(events: DataFrame) -> DataFrame:
    """Steps whose last start has no end: what a repair closes."""
    ends = ("step_completed", "step_failed", "step_paused", "interrupted")
    per = events.groupBy("pipeline_id", "step").agg(F.max(F.when(F.col("type") == "step_started", F.col("seq"))).alias("started"), F.max(F.when(F.col("type").isin(*ends), F.col("seq"))).alias("_e"))
    return per.where("started IS NOT NULL AND (_e IS NULL OR _e < started)").select("pipeline_id", "step", "started")


def merged_context(events: DataFrame) -> DataFrame:
    """pipeline_id, key, value: the last value of every context key, from rows with a map `context`."""
    rows = events.where("type = 'context_updated'").select("pipeline_id", "seq", F.explode("context").alias("key", "value"))
    return rows.groupBy("pipeline_id", "key").agg(F.max_by("value", "seq").alias("value"))


def readable(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed rows of (pos, line); a last line that is torn is dropped, an earlier one is an error."""
    parsed = lines.select("pos", F.from_json("line", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("pos", "r.*")
    last = lines.agg(F.max("pos").alias("_last"))
    out = parsed.crossJoin(F.broadcast(last)).where(~(F.col("_bad").isNotNull() & (F.col("pos") == F.col("_last"))))
    return out.withColumn("pos", F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("corrupt line "), F.col("pos")))).otherwise(F.col("pos"))).drop("_bad", "_last")


def log_rows(log: DataFrame, source: str | None = None, kind: str | None = None, since: int | None = None) -> DataFrame:
    """Rows of an audit log by source and kind, after a sequence number."""
    out = log
    for name, value in (("source", source), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out if since is None else out.where(F.col("seq") > since)


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last n rows, in order; a page."""
    return log.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def escalations(events: DataFrame) -> DataFrame:
    """task_id, paused, questions: a task is paused from an escalation until it is resumed."""
    n = lambda k: F.sum((F.col("kind") == k).cast("int"))
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("seq")))
    out = events.groupBy("task_id").agg(n("question").alias("questions"), at("escalate").alias("_e"), at("resume").alias("_r"))
    return out.select("task_id", (F.col("_e").isNotNull() & (F.col("_r").isNull() | (F.col("_r") < F.col("_e")))).alias("paused"), "questions")
