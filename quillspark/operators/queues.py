"""Queues, leases and workflows as folds over rows and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scores

# Limits of leases and retries, and the workflow.
LEASE, STALE, ATTEMPTS = 7200, 3600, 3
TRANSITIONS = (("research", "ready"), ("ready", "in_progress"), ("in_progress", "qa"), ("qa", "qa_passed"), ("blocked", "research"), ("blocked", "ready"))
DONE = "qa_passed"
URGENCY = {"red": 0, "yellow": 1, "green": 2}
STATUS_RENAMES = {"pending": "research", "completed": "qa_passed", "cancelled": "blocked"}
DAILY_CAP = 30
# End of fixed values.


def status_counts(tasks: DataFrame, status: str = "status") -> DataFrame:
    return tasks.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def queue_order(tasks: DataFrame) -> DataFrame:
    """Urgency, then priority, then age."""
    return tasks.orderBy(scores.lookup(URGENCY, F.col("urgency"), 9), "priority", "created_at", "id")


def project_rollup(tasks: DataFrame) -> DataFrame:
    """Totals by project; the percentage is half to even."""
    n = lambda c: F.sum(c.cast("int"))
    out = tasks.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), n(F.col("status") == DONE).alias("done"), n(F.col("status") == "blocked").alias("blocked"), n(F.col("urgency") == "red").alias("red"), n(F.col("urgency") == "yellow").alias("yellow")
    )
    return out.withColumn("completion_pct", F.bround(F.col("done") / F.col("total") * 100, 0).cast("int"))


def run_outcomes(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """assignee, completed, failed of the runs of known tasks."""
    joined = runs.join(tasks.select("task_id", "assignee"), "task_id")
    n = lambda *v: F.sum(F.col("outcome").isin(*v).cast("int"))
    return joined.groupBy("assignee").agg(n("completed").alias("completed"), n("failed", "crashed").alias("failed"))


def retry_distribution(runs: DataFrame) -> DataFrame:
    """How many tasks had how many retries, six and more together."""
    per = runs.groupBy("task_id").agg((F.count(F.lit(1)) - 1).alias("_r"))
    return per.groupBy(F.when(F.col("_r") > 5, "6+").otherwise(F.col("_r").cast("string")).alias("retries")).agg(F.count(F.lit(1)).alias("tasks"))


def run_report(runs: DataFrame) -> DataFrame:
    return runs.groupBy("outcome").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("task_id").alias("tasks"))


def dispatched(ready: DataFrame, running: DataFrame, cap: int, workers: int) -> DataFrame:
    """The tasks to start: at most `cap` for an assignee with those running, then the first `workers` of all. The second step
    ranks at most `workers` rows a task, as a top-k."""
    busy = running.groupBy("assignee").agg(F.count(F.lit(1)).alias("_busy"))
    rows = ready.join(busy, "assignee", "left")
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("assignee").orderBy("priority", "created_at", "task_id")))
    return rows.where(F.col("_r") <= cap - F.coalesce("_busy", F.lit(0))).drop("_r", "_busy").orderBy("priority", "created_at", "task_id").limit(workers)


def lease_states(events: DataFrame, now: Column, lease: int = LEASE, stale: int = STALE, attempts: int = ATTEMPTS) -> DataFrame:
    """task_id, claims, failures, last_beat (-1: none), state from events (task_id, at in seconds, kind).

    A claim opens a lease, heartbeats extend it, `fail` closes it; an open lease is reaped when it or its heartbeat is too
    old; as many failures as attempts are a dead letter. One aggregation, combined before its shuffle.
    """
    at = lambda *k: F.max(F.when(F.col("kind").isin(*k), F.col("at")))
    n = lambda k: F.sum((F.col("kind") == k).cast("int"))
    out = events.groupBy("task_id").agg(n("claim").alias("claims"), n("fail").alias("_f"), at("claim", "heartbeat").alias("last_beat"), at("claim").alias("_claim"), at("complete", "fail").alias("_end"), n("complete").alias("_done"))
    open_ = F.col("_claim").isNotNull() & (F.col("_end").isNull() | (F.col("_end") < F.col("_claim")))
    reaped = open_ & ((now - F.col("last_beat") > stale) | (now - F.col("_claim") > lease))
    failures = F.col("_f") + reaped.cast("int")
    state = F.when(F.col("_done") > 0, "done").when(failures >= attempts, "dead_letter").when(open_ & ~reaped, "running").otherwise("ready")
    return out.select("task_id", "claims", failures.alias("failures"), F.coalesce("last_beat", F.lit(-1)).alias("last_beat"), state.alias("state"))


def retry_at(failed_at: Column, attempt: Column) -> Column:
    """When a task may be tried again, in seconds."""
    return failed_at + scores.backoff_seconds(attempt)


def invalid_transitions(history: DataFrame) -> DataFrame:
    """task_id, seq, before, status of steps that the workflow has not; anything but a finished task may be blocked."""
    w = W.partitionBy("task_id").orderBy("seq")
    rows = history.select("task_id", "seq", F.lag("status").over(w).alias("before"), "status").where("before IS NOT NULL AND before <> status")
    allowed = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("status")) for a, b in TRANSITIONS])
    ok = F.array_contains(allowed, F.struct("before", "status")) | ((F.col("status") == "blocked") & (F.col("before") != DONE))
    return rows.where(~ok)


def spawn_allowed(spawns: DataFrame, at: str, cap: int = DAILY_CAP) -> DataFrame:
    """day, n, allowed."""
    return spawns.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.col("n") < cap)


def over_step_cap(steps: DataFrame, cap: int = 20) -> DataFrame:
    """The steps after the cap, per task."""
    return steps.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("task_id").orderBy("seq"))).where(F.col("_n") > cap).drop("_n")


def not_applied(effects: DataFrame, log: DataFrame) -> DataFrame:
    """Side effects that are not in the log, each once."""
    return effects.dropDuplicates(["kind", "detail"]).join(log, ["kind", "detail"], "left_anti")


def renamed_statuses(tasks: DataFrame) -> DataFrame:
    return tasks.replace(STATUS_RENAMES, subset=["status"])


def child_states(parents: DataFrame, children: DataFrame) -> DataFrame:
    """parent_id, child_id, state: the latest state of every child, `timeout` if there is none."""
    last = children.groupBy("child_id").agg(F.max_by("status", "at").alias("_s"))
    return parents.join(last, "child_id", "left").select("parent_id", "child_id", F.coalesce("_s", F.lit("timeout")).alias("state"))


def with_project_titles(rollup: DataFrame, missions: DataFrame) -> DataFrame:
    """Projects with the title of their mission, or their name."""
    return rollup.join(missions.select(F.col("slug").alias("project"), "title"), "project", "left").withColumn("title", F.coalesce("title", F.col("project").cast("string")))


def with_article_slugs(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Tasks with the sorted slugs of their articles: one join instead of a look-up for each."""
    slugs = links.groupBy("task_id").agg(F.array_sort(F.collect_set("article_slug")).alias("articles"))
    return tasks.join(slugs, "task_id", "left").withColumn("articles", F.coalesce("articles", F.array().cast("array<string>")))


def listed(tasks: DataFrame, status: str | None = None, urgency: str | None = None, project: str | None = None) -> DataFrame:
    """The filters that are given, all of them."""
    out = tasks
    for name, value in (("status", status), ("urgency", urgency), ("project", project)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def without_task(tasks: DataFrame, links: DataFrame, task_id) -> tuple[DataFrame, DataFrame]:
    """Both tables without a task."""
    return tasks.where(F.col("task_id") != task_id), links.where(F.col("task_id") != task_id)


def bounded_rounds(step, most: int = 10) -> list:
    """Results of a step until it says `complete` or `blocked`, in so many rounds at most. A loop of the driver over its own reports."""
    done = []
    for k in range(most):
        done.append(step(k, done[-1] if done else None))
        if done[-1].get("status") in ("complete", "blocked"):
            break
    return done


def enqueued(tasks: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """The queue (filepath, priority, status, attempts, created_at, updated_at, result) with new files (filepath, priority; 0 where it is null) as pending tasks."""
    new = files.select("filepath", F.coalesce("priority", F.lit(0)).alias("priority"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("result"))
    return tasks.unionByName(new)


def completed(tasks: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The queue with tasks completed: done has filepath, created_at and result ('' where it is null)."""
    marks = done.select("filepath", "created_at", F.coalesce("result", F.lit("")).alias("_result")).dropDuplicates(["filepath", "created_at"])
    rows = tasks.join(marks, ["filepath", "created_at"], "left")
    hit = F.col("_result").isNotNull()
    put = lambda n, v: F.when(hit, v).otherwise(F.col(n)).alias(n)
    return rows.select("filepath", "priority", put("status", F.lit("completed")), "attempts", "created_at", put("updated_at", now), put("result", F.col("_result")))


def with_procedures(tasks: DataFrame, articles: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Tasks (task_id, title, objective, approach, verification, tags) with the slug of a procedure article for each, and these articles. A slug that an article or a task before has is made
    unique by a part of the hash of the task; titles are compared by their slugs, so the tasks of one title are ranked together."""
    base = F.regexp_replace(F.concat(F.lit("proc-"), F.replace(F.lower("title"), F.lit(" "), F.lit("-")).substr(1, 60)), "[^a-z0-9-]", "").substr(1, 80)
    rows = tasks.withColumn("_base", base).join(articles.select(F.col("slug").alias("_base"), F.lit(True).alias("_taken")).distinct(), "_base", "left")
    first = F.min("task_id").over(W.partitionBy("_base"))
    unique = F.concat(F.col("_base").substr(1, 60), F.lit("-"), F.substring(F.md5(F.col("task_id").cast("string").cast("binary")), 1, 8))
    rows = rows.withColumn("procedure", F.when((F.col("task_id") == first) & F.col("_taken").isNull(), F.col("_base")).otherwise(unique))
    tags = F.slice(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("procedure"), F.lit("task"))), 1, 8)
    made = rows.select(
        F.col("procedure").alias("slug"), F.concat(F.lit("Procedure: "), "title").alias("title"), F.lit("procedure").alias("type"), "task_id", "objective", "approach", "verification", tags.alias("keywords"),
        F.concat(F.lit("Implementation guide for task: "), "title").alias("summary"), F.lit(0.9).alias("confidence"), today.alias("created_at"), F.add_months(today, 12).alias("next_review_at"),
    )
    return rows.select(*tasks.columns, F.array("procedure").alias("article_slugs")), made
