"""Statistics, text quality and queue reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import eventlog as E
from quillspark.operators import queues as Q
from quillspark.operators import stats as ST
from quillspark.plans import sql
from quillspark.plans.article_queries import view
from quillspark.plans.registry import register
from quillspark.session import table, texts


@register(
    "corpus_stats",
    f"""WITH {sql.ARTICLES}, c AS (SELECT 'type' AS dimension, type AS value FROM art UNION ALL SELECT 'lifecycle', lifecycle FROM art UNION ALL SELECT 'sensitivity', sensitivity FROM art
UNION ALL SELECT 'confidence', CASE WHEN confidence < 0.3 THEN '0.0-0.3' WHEN confidence < 0.6 THEN '0.3-0.6' WHEN confidence < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END FROM art) SELECT dimension, value, count(*) AS n FROM c GROUP BY 1, 2""",
)
def corpus_stats(spark, sf_dir):
    return ST.corpus_stats(view(spark, sf_dir, confidence=True))


@register("paper_stats", "SELECT count(*) AS papers, CAST(sum(len(text)) AS BIGINT) AS total_chars, CAST(floor(avg(len(text))) AS BIGINT) AS avg_chars, max(len(text)) AS max_chars, min(len(text)) AS min_chars FROM documents")
def paper_stats(spark, sf_dir):
    return ST.paper_stats(table(spark, sf_dir, "documents"), F.length("text").cast("long"))


def notes(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("unread", "skimmed", "annotated", "synthesized"))), (F.floor(F.col("doc_id") / 8) % 4 + 1).cast("int"))
    return view(spark, sf_dir).withColumn("reading_status", status)


_notes = "nt AS (SELECT *, ['unread', 'skimmed', 'annotated', 'synthesized'][CAST((doc_id // 8) % 4 + 1 AS INT)] AS reading_status FROM art WHERE type = 'research-note')"


@register("reading_stats", f"WITH {sql.ARTICLES}, {_notes} SELECT reading_status, count(*) AS n FROM nt GROUP BY 1")
def reading_stats(spark, sf_dir):
    return ST.reading_stats(notes(spark, sf_dir))


@register("promote_ready", f"WITH {sql.ARTICLES}, {_notes} SELECT source AS topic, count(*) AS notes, CAST(sum(CAST(reading_status = 'synthesized' AS INT)) AS BIGINT) AS synthesized, min(slug) AS first_slug FROM nt GROUP BY source HAVING count(*) >= 3")
def promote_ready(spark, sf_dir):
    return ST.promote_ready(notes(spark, sf_dir).where("type = 'research-note'"), F.col("source"))


@register(
    "contradictions",
    f"WITH {sql.ARTICLES} SELECT slug, 'doc-' || (doc_id + 1) AS other_slug, ['contradicts', 'extends', 'gap'][CAST((doc_id // 8) % 3 + 1 AS INT)] AS relationship FROM art WHERE type = 'research-note' AND (doc_id // 8) % 3 <> 1",
)
def contradictions(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("contradicts", "extends", "gap"))), (F.floor(F.col("doc_id") / 8) % 3 + 1).cast("int"))
    one = F.struct(F.concat(F.lit("doc-"), F.col("doc_id") + 1).alias("other_slug"), kind.alias("relationship"), F.lit("").alias("detail"))
    return ST.contradictions(view(spark, sf_dir).withColumn("paper_comparisons", F.array(one)))


MODULES = ("tion", "ing", "ment", "que", "zzz-none", "thth", "license", "akia")


@register(
    "coverage_audit",
    f"""WITH {sql.ARTICLES}, m(module) AS (VALUES {', '.join(f"('{m}')" for m in MODULES)}), h AS (SELECT module, type FROM m, art WHERE regexp_matches(lower(body), '(^|[^a-z0-9])' || module || '($|[^a-z0-9])'))
SELECT m.module, count(h.type) AS matches, CASE WHEN count(h.type) = 0 THEN 'UNDOCUMENTED' WHEN max(CAST(h.type = 'help' AS INT)) = 1 THEN 'DOCUMENTED' ELSE 'PARTIAL' END AS status FROM m LEFT JOIN h USING (module) GROUP BY m.module""",
)
def coverage_audit(spark, sf_dir):
    modules = spark.createDataFrame([(m,) for m in MODULES], "module string")
    return ST.coverage(modules, view(spark, sf_dir))


_sent = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> ''))), lambda n: n >= 3)"
_words = "regexp_extract_all(lower(text), '[a-zA-Z'']+')"


@register(
    "text_variance",
    f"""WITH s AS (SELECT doc_id, {_sent} AS l, {_words} AS w FROM documents), f AS (SELECT * FROM s WHERE len(l) >= 3),
m AS (SELECT doc_id, len(l) AS sentences, CAST(list_sum(l) AS DOUBLE) / len(l) AS mean, len(w) AS n, l, CAST(list_sum(list_transform(w, lambda x: len(x))) AS DOUBLE) AS c FROM f),
v AS (SELECT *, sqrt(list_sum(list_transform(l, lambda x: (x - mean) * (x - mean))) / sentences) AS sd FROM m),
wc AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM f) GROUP BY 1, 2), wr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS r FROM wc),
wa AS (SELECT doc_id, count(*) AS u, sum(CAST(k = 1 AS INT)) AS h, sum(CASE WHEN r <= 5 THEN k ELSE 0 END) AS t FROM wr GROUP BY doc_id)
SELECT doc_id, sentences, n AS total_words, coalesce(u, 0) AS unique_words, round(mean, 1) AS sentence_mean, round(sd, 1) AS sentence_std, round(sd / mean, 3) AS sentence_cv, round(CASE WHEN n > 0 THEN CAST(u AS DOUBLE) / n ELSE 0 END, 3) AS ttr,
 round(CASE WHEN n > 0 THEN CAST(h AS DOUBLE) / n ELSE 0 END, 3) AS hapax_ratio, round(CASE WHEN n > 0 THEN c / n ELSE 0 END, 1) AS avg_word_len, round(CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n ELSE 0 END, 3) AS repetition_ratio FROM v LEFT JOIN wa USING (doc_id)""",
)
def text_variance(spark, sf_dir):
    return ST.text_variance(texts(spark, sf_dir))


@register("sentence_histogram", f"SELECT CAST(floor(n / 5) * 5 AS BIGINT) AS bucket, count(*) AS sentences FROM (SELECT unnest({_sent}) AS n FROM documents) GROUP BY 1")
def sentence_histogram(spark, sf_dir):
    return ST.sentence_histogram(texts(spark, sf_dir))


def _count(name: str) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in ST.CATEGORIES[name])
    return f"len(list_filter(w, lambda x: x IN ({listed}))) AS {name}"


_share = "round(CAST({0} AS DOUBLE) / greatest(total, 1) * 100, 1) AS {1}"


@register(
    "category_ratios",
    f"""WITH s AS (SELECT doc_id, {_words} AS w FROM documents), c AS (SELECT doc_id, len(w) AS total, {', '.join(map(_count, ST.CATEGORIES))} FROM s)
SELECT *, {_share.format('nouns', 'noun_ratio')}, {_share.format('pronouns', 'pronoun_ratio')}, {_share.format('auxiliaries', 'aux_ratio')}, {_share.format('adjectives', 'adj_ratio')},
 round(CAST(nouns AS DOUBLE) / greatest(pronouns, 1), 1) AS noun_pronoun_ratio, {_share.format('(pronouns + auxiliaries)', 'functional_ratio')} FROM c""",
)
def category_ratios(spark, sf_dir):
    return ST.category_ratios(texts(spark, sf_dir))


PHRASES = [("tion", "syllable", "~2x"), ("the_of", "formulaic_phrase", "~50x"), ("que_la", "formulaic_phrase", "~35x"), ("ing", "syllable", "~1x"), ("mente", "syllable", "none"), ("thth", "syllable", "~30x"), ("nowhere", "syllable", "~9x")]
_phrases = ", ".join(f"('{w.replace('_', ' ')}', '{c}', CAST({r.strip('~x') if r != 'none' else 1.0} AS DOUBLE))" for w, c, r in PHRASES)


@register(
    "phrase_scan",
    f"""WITH p(w, c, r) AS (VALUES {_phrases}), d AS (SELECT doc_id, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS t, len({_words}) AS n FROM documents),
m AS (SELECT doc_id, n, c, r, (len(t) - len(replace(t, w, ''))) // len(w) AS k FROM d, p), f AS (SELECT doc_id, max(n) AS n, CAST(sum(CAST(k > 0 AS INT)) AS BIGINT) AS matches, CAST(sum(CAST(k > 0 AND (c = 'formulaic_phrase' OR r >= 30) AS INT)) AS BIGINT) AS severe, sum(k * r) AS i FROM m GROUP BY doc_id),
g AS (SELECT doc_id, matches, severe, round(i, 4) AS impact, round(i / greatest(n, 1) * 100, 4) AS density FROM f)
SELECT *, CASE WHEN matches = 0 THEN 'clean' WHEN severe >= 3 AND density > 5 THEN 'heavy' WHEN severe >= 1 OR density > 2 THEN 'moderate' ELSE 'light' END AS severity FROM g""",
)
def phrase_scan(spark, sf_dir):
    phrases = spark.createDataFrame(PHRASES, "word string, category string, ratio string")
    return ST.phrase_scan(texts(spark, sf_dir), phrases)


@register("dedup_groups", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_groups(spark, sf_dir):
    return ST.duplicate_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@register("quality_verdict", "SELECT doc_id, CASE WHEN len(trim(text)) < 500 THEN 'reject' WHEN len(trim(text)) < 5000 THEN 'warn' ELSE 'ok' END AS verdict FROM documents")
def quality_verdict(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.quality_verdict(F.col("text")).alias("verdict"))


_mixed = "lower(text || ' ' || ['First, step 1.', 'The study and its findings', 'milestone and timeline', 'architecture of the service api', 'a guide for usage', ''][CAST(doc_id % 6 + 1 AS INT)])"


def _type_sql() -> str:
    tests = " ".join(f"WHEN {' + '.join(f'''CAST(contains(t, '{m}') AS INT)''' for m in marks)} >= {least} THEN '{kind}'" for kind, marks, least in text.TYPE_MARKS)
    return f"SELECT doc_id, CASE {tests} ELSE 'base' END AS type FROM (SELECT doc_id, {_mixed} AS t FROM documents)"


@register("type_heuristic", _type_sql())
def type_heuristic(spark, sf_dir):
    extra = F.element_at(F.array(*map(F.lit, ("First, step 1.", "The study and its findings", "milestone and timeline", "architecture of the service api", "a guide for usage", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    return texts(spark, sf_dir).select("doc_id", text.article_type(F.concat("text", F.lit(" "), extra)).alias("type"))


@register("file_metrics", "SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(text) AS chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM documents")
def file_metrics(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.file_metrics(F.col("text")).alias("m")).select("doc_id", "m.lines", "m.chars", "m.words")


# queues on the order tables


def order_tasks(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "qa_passed").when(F.col("o_orderstatus") == "O", "ready").otherwise("in_progress")
    return t.select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 50).alias("assignee"), (F.col("o_custkey") % 20).alias("project"), F.col("o_custkey").alias("customer"), status.alias("status"), F.when(F.col("o_orderpriority").startswith("1"), "red").when(F.col("o_orderpriority").startswith("2"), "yellow").otherwise("green").alias("urgency"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"))


_tasks = "tk AS (SELECT o_orderkey AS task_id, o_custkey % 50 AS assignee, o_custkey % 20 AS project, o_custkey AS customer, CASE o_orderstatus WHEN 'F' THEN 'qa_passed' WHEN 'O' THEN 'ready' ELSE 'in_progress' END AS status, CASE o_orderpriority[1] WHEN '1' THEN 'red' WHEN '2' THEN 'yellow' ELSE 'green' END AS urgency, CAST(o_orderpriority[1] AS INT) AS priority, o_orderdate AS created_at FROM orders)"
_runs = "rn AS (SELECT l_orderkey AS task_id, l_linenumber AS run, CASE l_returnflag WHEN 'R' THEN 'crashed' WHEN 'A' THEN 'completed' ELSE 'failed' END AS outcome FROM lineitem)"


def line_runs(spark, sf_dir):
    outcome = F.when(F.col("l_returnflag") == "R", "crashed").when(F.col("l_returnflag") == "A", "completed").otherwise("failed")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("run"), outcome.alias("outcome"))


@register("queue_status", f"WITH {_tasks} SELECT status, count(*) AS n FROM tk GROUP BY 1")
def queue_status(spark, sf_dir):
    return Q.status_counts(order_tasks(spark, sf_dir))


@register("project_rollup", f"WITH {_tasks}, p AS (SELECT project, count(*) AS total, count(*) FILTER (WHERE status = 'qa_passed') AS done, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE urgency = 'red') AS red, count(*) FILTER (WHERE urgency = 'yellow') AS yellow FROM tk GROUP BY 1) SELECT *, CAST(round_even(CAST(done AS DOUBLE) / total * 100, 0) AS INT) AS completion_pct FROM p")
def project_rollup(spark, sf_dir):
    return Q.project_rollup(order_tasks(spark, sf_dir))


@register("run_report", f"WITH {_runs} SELECT outcome, count(*) AS runs, count(DISTINCT task_id) AS tasks FROM rn GROUP BY 1")
def run_report(spark, sf_dir):
    return Q.run_report(line_runs(spark, sf_dir))


@register("run_assignees", f"WITH {_tasks}, {_runs} SELECT assignee, count(*) FILTER (WHERE outcome = 'completed') AS completed, count(*) FILTER (WHERE outcome IN ('failed', 'crashed')) AS failed FROM rn JOIN tk USING (task_id) GROUP BY 1")
def run_assignees(spark, sf_dir):
    return Q.run_outcomes(line_runs(spark, sf_dir), order_tasks(spark, sf_dir))


@register("retry_distribution", f"WITH {_runs}, r AS (SELECT task_id, count(*) - 1 AS r FROM rn GROUP BY 1) SELECT CASE WHEN r > 5 THEN '6+' ELSE CAST(r AS VARCHAR) END AS retries, count(*) AS tasks FROM r GROUP BY 1")
def retry_distribution(spark, sf_dir):
    return Q.retry_distribution(line_runs(spark, sf_dir))


@register(
    "dispatch_caps",
    f"WITH {_tasks}, b AS (SELECT customer, count(*) AS busy FROM tk WHERE status = 'in_progress' GROUP BY 1), r AS (SELECT t.*, row_number() OVER (PARTITION BY t.customer ORDER BY priority, created_at, task_id) AS rk, coalesce(busy, 0) AS busy FROM tk t LEFT JOIN b ON t.customer = b.customer WHERE status = 'ready') SELECT task_id, customer AS assignee, priority FROM r WHERE rk <= 3 - busy ORDER BY priority, created_at, task_id LIMIT 20",
)
def dispatch_caps(spark, sf_dir):
    """Every customer is an assignee, with at most three tasks at a time."""
    t = order_tasks(spark, sf_dir).withColumn("assignee", F.col("customer"))
    return Q.dispatched(t.where("status = 'ready'"), t.where("status = 'in_progress'"), 3, 20).select("task_id", "assignee", "priority")


@register("task_list", f"WITH {_tasks} SELECT task_id, urgency, priority FROM tk WHERE status = 'ready' AND project = 3 ORDER BY CASE urgency WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END, priority, created_at, task_id LIMIT 100")
def task_list(spark, sf_dir):
    rows = order_tasks(spark, sf_dir).where("status = 'ready' AND project = 3").withColumn("id", F.col("task_id"))
    return Q.queue_order(rows).limit(100).select("task_id", "urgency", "priority")


@register("spawn_days", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) < 30 AS allowed FROM events WHERE event_type = 'purchase' GROUP BY 1")
def spawn_days(spark, sf_dir):
    return Q.spawn_allowed(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "ts").withColumn("day", F.col("day").cast("string"))


def lease_events(spark, sf_dir, events=None):
    e = table(spark, sf_dir, "events") if events is None else events
    kind = F.element_at(F.array(*map(F.lit, ("claim", "heartbeat", "heartbeat", "fail", "complete"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("task_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind"))


@register(
    "lease_reap",
    """WITH e AS (SELECT user_id * 10 + event_id % 10 AS task_id, epoch(date_trunc('second', ts))::BIGINT AS tm, ['claim', 'heartbeat', 'heartbeat', 'fail', 'complete'][CAST(event_id % 5 + 1 AS INT)] AS kind FROM events),
a AS (SELECT task_id, count(*) FILTER (WHERE kind = 'claim') AS claims, count(*) FILTER (WHERE kind = 'fail') AS f, max(tm) FILTER (WHERE kind IN ('claim', 'heartbeat')) AS last_beat, max(tm) FILTER (WHERE kind = 'claim') AS c, max(tm) FILTER (WHERE kind IN ('complete', 'fail')) AS e, count(*) FILTER (WHERE kind = 'complete') AS d FROM e GROUP BY 1),
o AS (SELECT *, c IS NOT NULL AND (e IS NULL OR e < c) AS o FROM a), r AS (SELECT *, o AND (1706700000 - last_beat > 3600 OR 1706700000 - c > 7200) AS reaped FROM o)
SELECT task_id, claims, f + CAST(reaped AS INT) AS failures, coalesce(last_beat, -1) AS last_beat, CASE WHEN d > 0 THEN 'done' WHEN f + CAST(reaped AS INT) >= 3 THEN 'dead_letter' WHEN o AND NOT reaped THEN 'running' ELSE 'ready' END AS state FROM r""",
)
def lease_reap(spark, sf_dir):
    return Q.lease_states(lease_events(spark, sf_dir), F.lit(1706700000))


def turn_log(spark, sf_dir, turns=None):
    t = table(spark, sf_dir, "conversations") if turns is None else turns
    kind = F.element_at(F.array(*map(F.lit, ("step_started", "step_completed", "status_changed", "step_failed", "unknown"))), ((F.col("turn") * 3 + F.col("conv_id")) % 5 + 1).cast("int"))
    return t.select(F.col("conv_id").alias("pipeline_id"), F.col("turn").alias("seq"), kind.alias("type"), F.concat(F.lit("s"), F.col("turn") % 3).alias("step"), F.col("role").alias("status"))


_log = "lg AS (SELECT conv_id AS pipeline_id, turn AS seq, ['step_started', 'step_completed', 'status_changed', 'step_failed', 'unknown'][CAST((turn * 3 + conv_id) % 5 + 1 AS INT)] AS type, 's' || turn % 3 AS step, role AS status FROM conversations)"


@register(
    "eventlog_fold",
    f"""WITH {_log}, s AS (SELECT pipeline_id, step, arg_max(type, seq) AS t, count(*) FILTER (WHERE type = 'step_started') AS a FROM lg WHERE type IN ('step_started', 'step_completed', 'step_failed') GROUP BY 1, 2),
p AS (SELECT pipeline_id, count(*) FILTER (WHERE t = 'step_completed') AS completed, count(*) FILTER (WHERE t = 'step_failed') AS failed, count(*) FILTER (WHERE t = 'step_started') AS open, CAST(sum(a) AS BIGINT) AS attempts FROM s GROUP BY 1),
l AS (SELECT pipeline_id, max(seq) AS last_seq, arg_max(status, seq) FILTER (WHERE type = 'status_changed') AS status FROM lg GROUP BY 1)
SELECT pipeline_id, last_seq, coalesce(status, 'pending') AS status, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(open, 0) AS open, coalesce(attempts, 0) AS attempts FROM l LEFT JOIN p USING (pipeline_id)""",
)
def eventlog_fold(spark, sf_dir):
    return E.pipeline_states(turn_log(spark, sf_dir))


@register("eventlog_changes", f"WITH {_log}, c AS (SELECT *, lag(status) OVER (PARTITION BY pipeline_id ORDER BY seq) AS before FROM lg) SELECT pipeline_id, seq, before, status FROM c WHERE before IS DISTINCT FROM status")
def eventlog_changes(spark, sf_dir):
    return E.changes(turn_log(spark, sf_dir), "pipeline_id", "seq", "status").select("pipeline_id", "seq", "before", "status")


@register("eventlog_interrupted", f"WITH {_log}, p AS (SELECT pipeline_id, step, max(seq) FILTER (WHERE type = 'step_started') AS started, max(seq) FILTER (WHERE type IN ('step_completed', 'step_failed')) AS e FROM lg GROUP BY 1, 2) SELECT pipeline_id, step, started FROM p WHERE started IS NOT NULL AND (e IS NULL OR e < started)")
def eventlog_interrupted(spark, sf_dir):
    return E.interrupted(turn_log(spark, sf_dir))


@register("latest_per_key", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return E.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@register("workflow_violations", "WITH h AS (SELECT conv_id AS task_id, turn AS seq, ['research', 'ready', 'in_progress', 'qa', 'qa_passed', 'blocked'][CAST((turn * turn + conv_id) % 6 + 1 AS INT)] AS status FROM conversations), l AS (SELECT task_id, seq, lag(status) OVER (PARTITION BY task_id ORDER BY seq) AS before, status FROM h) SELECT task_id, seq, before, status FROM l WHERE before <> status AND NOT (status = 'blocked' AND before <> 'qa_passed') AND (before, status) NOT IN (('research', 'ready'), ('ready', 'in_progress'), ('in_progress', 'qa'), ('qa', 'qa_passed'), ('blocked', 'research'), ('blocked', 'ready'))")
def workflow_violations(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    status = F.element_at(F.array(*map(F.lit, ("research", "ready", "in_progress", "qa", "qa_passed", "blocked"))), ((F.col("turn") * F.col("turn") + F.col("conv_id")) % 6 + 1).cast("int"))
    return Q.invalid_transitions(t.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), status.alias("status")))
