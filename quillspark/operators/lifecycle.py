"""Lifecycles of articles, tasks and missions: defaults, warnings, submissions, folds of their events, and renderings."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import biblio, scores, text
from quillspark.session import reach_workers

# Bounds of keywords and paragraphs, limits of the inbox.
KEYWORD_BOUNDS = {"keywords": (3, 15), "subject_keywords": (2, 8)}
PARAGRAPHS, SUMMARY = 5, 300
RETRIES = 3
# End of fixed values.
BODY_FIELDS = {"base": "content", "help": "explanation", "mission": "architecture"}


def inbound_links(articles: DataFrame) -> DataFrame:
    """slug, links: how many related or pinned entries name an article that exists; a pinned one that is related counts once."""
    targets = F.transform("related", lambda r: r["slug"])
    if "related_pinned" in articles.columns:
        targets = F.array_union(targets, F.coalesce("related_pinned", F.array().cast("array<string>")))
    named = articles.select(F.explode(targets).alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("_n"))
    return articles.select("slug").join(named, "slug", "left").select("slug", F.coalesce("_n", F.lit(0)).alias("links"))


def corpus_totals(articles: DataFrame, today: Column) -> DataFrame:
    """One row: articles, gaps, past reviews, orphans, mean keywords and links."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return articles.agg(
        F.count(F.lit(1)).alias("articles"),
        n(F.col("gap")).alias("gaps"),
        n(F.col("next_review_at") < today).alias("past_review"),
        n(F.coalesce("link_count", F.size("related")) == 0).alias("orphans"),
        F.round(F.avg(F.size("keywords")), 1).alias("avg_keywords"),
        F.round(F.avg(F.size("related")), 1).alias("avg_links"),
    )


def warnings(articles: DataFrame) -> DataFrame:
    """slug, warnings: advice that never fails a row."""
    rules = []
    for name, (low, high) in KEYWORD_BOUNDS.items():
        if name in articles.columns:
            rules += [F.when(F.size(name) < low, f"few {name}"), F.when(F.size(name) > high, f"many {name}")]
    if "body" in articles.columns:
        rules.append(F.when(text.paragraphs(F.col("body")) > PARAGRAPHS, "long body"))
    return articles.select("slug", F.array_compact(F.array(*rules)).alias("warnings"))


def with_defaults(articles: DataFrame) -> DataFrame:
    """Bodies that other backends do not have, by type."""
    stub = F.concat(F.lit("See the attached data of "), F.col("title"), F.lit("."))
    return articles.withColumn("body", F.coalesce(F.nullif("body", F.lit("")), F.when(F.col("backend") != "md", stub), F.lit("")))


def main_body(articles: DataFrame) -> DataFrame:
    """slug, body: the field that holds the text of a type."""
    have = [f for f in BODY_FIELDS.values() if f in articles.columns]
    out = F.col("formatted") if "formatted" in articles.columns else F.lit("")
    for kind, f in BODY_FIELDS.items():
        if f in have:
            out = F.when(F.col("type") == kind, F.col(f)).otherwise(out)
    return articles.select("slug", F.coalesce(out, F.lit("")).alias("body"))


def submitted(board: DataFrame, missions: DataFrame) -> DataFrame:
    """The missions to add: those without an open one of the same title, each title once."""
    return missions.dropDuplicates(["title"]).join(board.where("status <> 'done'").select("title"), "title", "left_anti")


def skills_as_articles(skills: DataFrame, known: DataFrame) -> DataFrame:
    """Process articles of skills that are not there yet."""
    new = skills.join(known.select("slug"), "slug", "left_anti")
    return new.select("slug", F.col("description").alias("title"), F.lit("process").alias("type"), "keywords", "steps", "outcome")


def task_states(events: DataFrame) -> DataFrame:
    """task_id, status, updated_at, completed_at from events (task_id, seq, at, status); completion only by `qa_passed`."""
    last = events.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.max("at").alias("updated_at"), F.max(F.when(F.col("status") == "qa_passed", F.col("at"))).alias("_c"))
    return last.select("task_id", "status", "updated_at", F.when(F.col("status") == "qa_passed", F.col("_c")).alias("completed_at"))


def inbox_states(events: DataFrame, retries: int = RETRIES) -> DataFrame:
    """task_id, attempts, status from events (task_id, seq, kind) of an inbox: `dequeue` counts an attempt, `fail` puts it back or,
    after the last attempt, away; `retry` brings a dead letter back."""
    n = lambda k: F.sum((F.col("kind") == k).cast("int"))
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("seq")))
    last_retry = F.max(F.when(F.col("kind") == "retry", F.col("seq"))).over(W.partitionBy("task_id"))
    live = events.withColumn("_from", last_retry).where("_from IS NULL OR seq >= _from")
    out = live.groupBy("task_id").agg(n("dequeue").alias("attempts"), F.max_by("kind", "seq").alias("_k"), at("dequeue").alias("_d"))
    status = F.when(F.col("_k") == "complete", "completed").when(F.col("_k") == "dequeue", "processing").when((F.col("_k") == "fail") & (F.col("attempts") >= retries), "dead_letter").otherwise("pending")
    return out.select("task_id", "attempts", status.alias("status"))


def handled(tasks: DataFrame, handler: Callable[[dict], str], retries: int = RETRIES) -> DataFrame:
    """task columns, result, error: a function applied to every task in parallel, tried again when it raises."""
    reach_workers(tasks.sparkSession)
    names = tasks.columns

    def work(batches):
        for pdf in batches:
            results, errors = [], []
            for row in pdf.to_dict("records"):
                result = error = None
                for _ in range(retries):
                    try:
                        result, error = handler(row), None
                        break
                    except Exception as e:  # the task's error is its result
                        error = str(e)
                results.append(result)
                errors.append(error)
            yield pdf.assign(result=pd.Series(results, dtype=object, index=pdf.index), error=pd.Series(errors, dtype=object, index=pdf.index))[[*names, "result", "error"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema) + ", result string, error string"
    return tasks.mapInPandas(work, schema)


def tick(board: DataFrame, now: Column, cap: int, workers: int) -> DataFrame:
    """task_id, action for one round: decompose roots without children, ask for a human where blocked, start what is ready."""
    ready = board.where("status = 'ready'").withColumn("_r", F.row_number().over(W.partitionBy("assignee").orderBy("priority", "created_at", "task_id")))
    start = ready.where(F.col("_r") <= cap).orderBy("priority", "created_at", "task_id").limit(workers).select("task_id", F.lit("dispatch").alias("action"))
    parents = board.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("task_id"))
    roots = board.where("status = 'research' AND parent_id IS NULL").join(parents, "task_id", "left_anti").select("task_id", F.lit("decompose").alias("action"))
    return start.union(roots).union(board.where("status = 'blocked'").select("task_id", F.lit("needs_human"))).withColumn("at", now)


def next_seq(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def handoff(tasks: DataFrame) -> DataFrame:
    """task_id, text: what the next round of a task is told."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return tasks.select("task_id", F.concat_ws("\n", F.concat(F.lit("Round "), F.col("round"), F.lit(" of "), F.col("most")), line("Objective", "objective"), line("So far", "summary"), F.lit("Report status, summary and evidence as JSON.")).alias("text"))


def audit_report(coverage: DataFrame) -> DataFrame:
    """One text: modules by status, in order."""
    rows = coverage.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("module")), ", ").alias("m"))
    lines = rows.select("status", F.concat("status", F.lit(" ("), F.col("n"), F.lit("): "), "m").alias("l"))
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", "l"))), lambda x: x["l"]), "\n").alias("report"))


def guessed_slugs(files: DataFrame, slugs: DataFrame) -> DataFrame:
    """path, slug of files named `NN_Author_YYYY_...`: the first slug that contains author and year. Slugs are joined on the year that they
    contain, so not every pair is looked at."""
    author = F.lower(F.regexp_extract("path", r"(?:^|/)\d+_([A-Za-z]+)_(\d{4})", 1))
    named = files.select("path", author.alias("_a"), F.regexp_extract("path", r"(?:^|/)\d+_([A-Za-z]+)_(\d{4})", 2).alias("_y")).where("_a <> ''")
    years = slugs.select("slug", F.explode(F.array_distinct(F.regexp_extract_all("slug", F.lit(r"(\d{4})"), F.lit(1)))).alias("_y"))
    return named.join(years, "_y").where(F.contains("slug", F.col("_a"))).groupBy("path").agg(F.min("slug").alias("slug"))


def citations(notes: DataFrame) -> DataFrame:
    """slug, author, year, title, journal, doi, cite_key of research notes that can be cited, keys told apart in order of slug."""
    t = F.col("title")
    rows = notes.select("slug", biblio.title_author(t).alias("author"), biblio.title_year(t).alias("year"), biblio.clean_title(t).alias("title"), biblio.journal(F.col("summary")).alias("journal"), F.coalesce(biblio.doi(F.col("summary")), biblio.doi(F.col("body"))).alias("doi"))
    rows = rows.where("title <> '' AND (author IS NOT NULL OR doi IS NOT NULL)")
    base = F.concat(F.coalesce("author", F.lit("Anon")), F.coalesce(F.col("year").cast("string"), F.lit("")))
    nth = F.row_number().over(W.partitionBy(base).orderBy("slug"))
    return rows.withColumn("_n", nth).withColumn("cite_key", biblio.cite_key(base, F.col("_n"), F.col("title"))).drop("_n")


def merged_citation(*sources: Mapping[str, Column]) -> dict[str, Column]:
    """Field by field, the first source that has it."""
    names = dict.fromkeys(k for s in sources for k in s)
    return {n: F.coalesce(*[s[n] for s in sources if n in s]) for n in names}


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def changed_since(files: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to index again (new or newer), and paths that are gone."""
    known = index.select("path", F.col("modificationTime").alias("_t"))
    fresh = files.join(known, "path", "left").where("_t IS NULL OR modificationTime > _t").drop("_t")
    return fresh, index.join(files.select("path"), "path", "left_anti").select("path")


def merged_config(defaults: dict, given: dict | None = None, env: Mapping[str, str] | None = None, prefix: str = "QUILLSPARK_") -> dict:
    """Environment over file over defaults, level by level; `PREFIX_A__B` sets a.b."""

    def merge(a: dict, b: Mapping) -> dict:
        return {**a, **{k: merge(a[k], v) if isinstance(v, Mapping) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    out = merge(defaults, given or {})
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(prefix):
            *path, last = name[len(prefix) :].lower().split("__")
            nested: dict = {last: value}
            for key in reversed(path):
                nested = {key: nested}
            out = merge(out, nested)
    return out


def templates() -> dict[str, dict]:
    """What every type of article starts from."""
    return {t: {"type": t, "review_days": scores.REVIEW_DAYS.get(t, 365), "keywords": [], "lifecycle": "current", "sensitivity": "internal", "confidence": 0.8} for t in scores.TYPES}
