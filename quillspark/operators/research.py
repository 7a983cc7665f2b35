"""Research runs and batch ingestion as DataFrame steps; searching and reviewing are functions that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import biblio, text
from quillspark.operators import search as S
from quillspark.session import saved

SPILL = 4000
ICONS = {"confirms": "[confirms]", "extends": "[extends]", "contradicts": "[contradicts]"}


def plan(questions: DataFrame) -> DataFrame:
    """plan_id, question, sub_questions, queries, perspectives for rows with a question."""
    subs = text.sub_questions(F.col("question"))
    return questions.select(
        F.concat(F.lit("plan-"), F.substring(F.md5(F.col("question").cast("binary")), 1, 12)).alias("plan_id"), "question", subs.alias("sub_questions"), text.research_queries(subs).alias("queries"), F.array(*map(F.lit, text.PERSPECTIVES)).alias("perspectives")
    )


def structured(raw: DataFrame) -> DataFrame:
    """finding_id, claim, source_title, source_url: either of the two shapes of a finding; long claims are shortened."""
    have = set(raw.columns)

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in have], F.lit(""))

    claim = first("claim", "snippet", "content")
    return raw.select("finding_id", F.when(F.length(claim) > SPILL, text.preview(claim, 500)).otherwise(claim).alias("claim"), first("source_title", "title").alias("source_title"), first("source_url", "url").alias("source_url"))


def cross_referenced(findings: DataFrame, articles: DataFrame, least: float = 1.0) -> DataFrame:
    """Findings with their best article and how they relate to it; null where none is near enough."""
    best = S.best_matches(findings, articles, least)
    out = findings.join(best, "finding_id", "left")
    return out.withColumn("relationship", F.when(F.col("slug").isNotNull(), text.relationship(F.col("claim"))))


def gates(question: str | None, findings: DataFrame) -> list[str]:
    """What keeps a result from being stored."""
    problems = [] if (question or "").strip() else ["no question"]
    if not findings.limit(1).count():
        return problems + ["no findings"]
    return problems + (["a finding without a claim"] if findings.where("claim IS NULL OR trim(claim) = ''").limit(1).count() else [])


def report(question: str, findings: DataFrame) -> DataFrame:
    """One Markdown text: findings in order, with their relations and sources. A report is small: it is one run's."""
    icon = F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])[F.col("relationship")]
    line = F.concat(F.lit("- "), F.coalesce(F.concat(icon, F.lit(" ")), F.lit("")), text.smart_truncate(F.col("claim"), 200), F.when(F.col("source_title") != "", F.concat(F.lit(" ("), F.col("source_title"), F.lit(")"))).otherwise(""))
    lines = findings.select("finding_id", line.alias("_l")).agg(F.transform(F.sort_array(F.collect_list(F.struct("finding_id", "_l"))), lambda x: x["_l"]).alias("_all"))
    return lines.select(F.concat(F.lit(f"# {question}\n\n## Findings\n\n"), F.array_join("_all", "\n")).alias("report"))


def run(question: str, articles: DataFrame, search_fn: Callable[[str], DataFrame], review: Callable[[DataFrame], bool] = lambda _: True) -> dict:
    """Plan, search, structure, cross-reference, report, review; `search_fn` gives findings for a query. The driver only holds
    the plan's five queries; findings stay DataFrames."""
    spark = articles.sparkSession
    steps = plan(spark.createDataFrame([(question,)], "question string")).first()
    found = None
    for k, query in enumerate(steps["queries"]):
        part = structured(search_fn(query)).withColumn("finding_id", F.concat(F.lit(f"{k}-"), F.col("finding_id")))
        found = part if found is None else found.unionByName(part)
    problems = gates(question, found)
    if problems:
        return {"status": "failed", "problems": problems}
    linked = cross_referenced(found, articles)
    text_ = report(question, linked)
    return {"status": "completed" if review(text_) else "paused", "plan_id": steps["plan_id"], "findings": linked, "report": text_}


REPORT_FIELDS = ("status", "summary", "evidence")


def report_errors(doc: Column, most: int = 20_000) -> Column:
    """What is wrong with a worker's JSON report; empty if nothing is."""
    get = lambda name: F.get_json_object(doc, f"$.{name}")
    rules = [
        F.when(F.length(doc) > most, "too long"),
        F.when(F.json_object_keys(doc).isNull(), "no object"),
        *[F.when(get(n).isNull(), f"no {n}") for n in REPORT_FIELDS],
        F.when(~F.coalesce(get("status"), F.lit("")).isin("complete", "blocked", "continue"), "unknown status"),
    ]
    return F.array_compact(F.array(*rules))


#: Most keywords of an article of which all subsets are listed; articles with more are joined by single keywords.
LISTED = 12


def subsets(words: Column) -> Column:
    """Every subset of some words, each word with a comma before it, in order."""
    return F.aggregate(F.array_sort(words), F.array(F.lit("")), lambda every, w: F.concat(every, F.transform(every, lambda x: F.concat(x, F.lit(","), w))))


def nearest(words: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """name, _ratio, _shared of the article that is nearest to each file: most of the smaller set shared, then most shared.

    Rows: (name, kw), (slug, kw, _size). No file is held against every article of a keyword: what a file shares with an article is a subset of both, so the subsets of the words are looked up among those
    of the articles, where the smallest article of a subset gives the best ratio. Both sides are a bounded number of rows a text.
    """
    words, known = saved(words), saved(known)
    own = words.groupBy(name).agg(F.count(F.lit(1)).alias("_own"), F.collect_list("kw").alias("_w"))
    met = words.join(known.select("kw").distinct(), "kw", "left_semi").groupBy(name).agg(F.collect_list("kw").alias("_w")).join(own.drop("_w"), name)
    held = known.join(words.select("kw").distinct(), "kw", "left_semi").groupBy("slug", "_size").agg(F.collect_list("kw").alias("_w"))
    held = saved(held)
    key = F.explode(subsets(F.col("_w"))).alias("_key")
    least = held.where(F.size("_w") <= LISTED).select("_size", key).where("_key <> ''").groupBy("_key").agg(F.min("_size").alias("_size"))
    some = F.length("_key") - F.length(F.replace("_key", F.lit(","), F.lit("")))
    found = met.select(name, "_own", key).where("_key <> ''").join(least, "_key").select(name, "_own", "_size", some.cast("long").alias("_shared"))
    if held.where(F.size("_w") > LISTED).limit(1).count():
        wide = held.where(F.size("_w") > LISTED).select("slug", "_size", F.explode("_w").alias("kw"))
        more = words.join(wide, "kw").groupBy(name, "slug", "_size").agg(F.count(F.lit(1)).alias("_shared")).join(own, name)
        found = found.unionByName(more.select(name, "_own", "_size", "_shared"))
    best = F.max(F.struct((F.col("_shared") / F.least("_size", "_own")).alias("_ratio"), "_shared")).alias("_b")
    return found.groupBy(name).agg(best).select(name, "_b._ratio", "_b._shared")


def ingested(files: DataFrame, articles: DataFrame, content: str = "text", name: str = "path") -> DataFrame:
    """path, outcome, doi for a batch of texts: duplicates by content, quality, and likeness to the keywords of articles.

    A file is a duplicate if another of the same content comes before it by name. What is needed of a text is taken out where it is read, so texts are not shuffled.
    """
    c = F.col(content)
    rows = files.select(name, F.md5(c.cast("binary")).alias("_h"), text.quality_verdict(c).alias("_v"), biblio.doi(c).alias("doi"), text.extracted_keywords(c).alias("_k"))
    rows = saved(rows.withColumn("_n", F.row_number().over(W.partitionBy("_h").orderBy(name))))
    words = rows.where("_n = 1").select(name, F.explode("_k").alias("kw"))
    known = articles.select("slug", F.explode(F.array_distinct("keywords")).alias("kw"), F.size("keywords").alias("_size"))
    out = rows.join(nearest(words, known, name), name, "left")
    like = text.similarity_verdict(F.coalesce("_ratio", F.lit(0.0)), F.coalesce("_shared", F.lit(0)))
    outcome = F.when(F.col("_n") > 1, "duplicate").when(F.col("_v") == "reject", "rejected").when(like == "SKIP", "skipped").when(like == "REVIEW", "review").otherwise("ingested")
    return out.select(name, outcome.alias("outcome"), "doi")


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# What is kept of a result.
NOTES, SOURCES, SUMMARY, TOPIC = 10, 5, 250, 80
# End of fixed values.


def persisted(results: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New articles of research results (question, findings: key_claim, title, url; gaps; synthesis), and what became of each: question, error, research_note, base_article.

    Without a question, findings, or a claim in them nothing is made. A result makes a research note, and a base article if it has a synthesis; an article that is there stays as it is, and of results with one
    slug the first by question makes it.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    findings = F.coalesce("findings", F.array().cast(results.schema["findings"].dataType))
    error = (
        F.when(blank(F.col("question")), "question is empty").when(F.size(findings) == 0, "no findings to persist").when(~F.exists(findings, lambda f: ~blank(f["key_claim"])), "no findings with a non-empty key_claim")
    )
    text_of = lambda c: F.coalesce(c, F.lit(""))
    topic = text.smart_truncate(F.col("question"), TOPIC)
    lines = F.filter(F.transform(F.split(text_of(F.col("synthesis")), "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    summary = F.coalesce(F.get(lines, F.lit(0)), F.concat(F.lit("Deep research findings on: "), topic)).substr(1, SUMMARY)
    some = F.slice(findings, 1, NOTES)
    rows = results.withColumns({
        "error": error, "_slug": text.slug_from_question(F.col("question")), "_topic": topic, "summary": summary,
        "key_notes": F.transform(some, lambda f: F.concat(text_of(f["key_claim"]), F.lit(" ["), text_of(f["title"]), F.lit("]"))),
        "sources": F.transform(some, lambda f: F.concat(text_of(f["title"]), F.lit(": "), text_of(f["url"]))),
        "_urls": F.transform(F.slice(findings, 1, SOURCES), lambda f: text_of(f["url"])),
        "open_questions": F.when(F.size("gaps") > 0, F.col("gaps")).otherwise(F.array(F.lit("No significant gaps identified"))),
    })
    good = rows.where("error IS NULL")
    made = {}
    for kind, slug, title, provenance, content in (
        ("research-note", F.concat(F.lit("research-"), "_slug"), F.concat(F.lit("Research: "), "_topic"), F.col("_urls"), F.lit(None).cast("string")),
        ("base", F.substring("_slug", 1, 45), F.col("_topic"), F.array(F.lit("deep-research-synthesis")), F.col("synthesis")),
    ):
        new = (good if kind == "research-note" else good.where(~blank(F.col("synthesis")))).select(
            "question", slug.alias("slug"), title.alias("title"), F.lit(kind).alias("type"), "summary", "key_notes", "open_questions", "sources", provenance.alias("provenance"), content.alias("content")
        )
        new = new.withColumn("_r", F.row_number().over(W.partitionBy("slug").orderBy("question"))).where("_r = 1").drop("_r")
        made[kind] = new.join(articles.select("slug"), "slug", "left_anti")
    note, base = (made[k].select("question", F.col("slug").alias(n)) for k, n in (("research-note", "research_note"), ("base", "base_article")))
    outcomes = rows.select("question", "error").join(note, "question", "left").join(base, "question", "left")
    return made["research-note"].unionByName(made["base"]).drop("question"), outcomes
