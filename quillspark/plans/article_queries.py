"""Queries over the article view: listing, checks, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scores, text
from quillspark.operators import articles as A
from quillspark.plans import sql
from quillspark.plans.registry import register
from quillspark.session import table, texts


def view(spark, sf_dir, confidence=False):
    """The article view; `labels` are joined only where confidence is asked for."""
    return A.article_view(texts(spark, sf_dir), table(spark, sf_dir, "labels") if confidence else None)


@register("article_list", f"WITH {sql.ARTICLES} SELECT slug, title, type, lifecycle, sensitivity, doc_type, body_words, retrieval_count, confidence FROM art WHERE type = 'plan' AND lifecycle = 'current' AND sensitivity IN ('public', 'internal')")
def article_list(spark, sf_dir):
    found = A.list_articles(view(spark, sf_dir, confidence=True), article_type="plan", lifecycle="current", access="internal")
    return found.select("slug", "title", "type", "lifecycle", "sensitivity", "doc_type", F.col("body_words").cast("long").alias("body_words"), "retrieval_count", "confidence")


@register("article_checks", f"WITH {sql.ARTICLES} SELECT slug, len(title) < 1 OR len(title) > 200 AS bad_title, confidence NOT BETWEEN 0 AND 1 AS bad_confidence FROM art")
def article_checks(spark, sf_dir):
    found = A.checks(view(spark, sf_dir, confidence=True))
    return found.select("slug", F.array_contains("errors", "title").alias("bad_title"), F.array_contains("errors", "confidence").alias("bad_confidence"))


@register(
    "review_dates",
    f"""WITH {sql.ARTICLES}, r AS (SELECT slug, type, DATE '2024-02-29' + CAST(doc_id % 60 AS INT) AS d, {sql.case(scores.REVIEW_DAYS, 'type', 365)} AS days FROM art)
SELECT slug, CAST(CAST(CASE WHEN days >= 365 THEN d + INTERVAL 1 YEAR ELSE d + CAST(days AS INT) END AS DATE) AS VARCHAR) AS next_review FROM r""",
)
def review_dates(spark, sf_dir):
    start = F.date_add(F.lit("2024-02-29").cast("date"), (F.col("doc_id") % 60).cast("int"))
    return view(spark, sf_dir).select("slug", scores.next_review(start, scores.review_days(F.col("type"))).cast("string").alias("next_review"))


@register("article_tags", f"WITH {sql.ARTICLES} SELECT slug, 'type/' || type || ',doc/' || doc_type || ',lifecycle/' || lifecycle AS tags, {sql.case(scores.TYPE_GROUP, 'type', 0)} + {sql.case(scores.LIFECYCLE_GROUP, 'lifecycle', 0)} AS node_group FROM art")
def article_tags(spark, sf_dir):
    return view(spark, sf_dir).select("slug", F.array_join(scores.tags(F.col("type"), F.col("doc_type"), F.col("lifecycle")), ",").alias("tags"), scores.node_group(F.col("type"), F.col("lifecycle")).alias("node_group"))


@register(
    "article_upsert",
    f"""WITH {sql.ARTICLES}, new AS (SELECT slug, title || ' v' || v AS title FROM art, (VALUES (2), (3)) x(v) WHERE doc_id % 5 = 0 AND v = 3)
SELECT slug, title FROM art WHERE doc_id % 5 <> 0 UNION ALL SELECT slug, title FROM new""",
)
def article_upsert(spark, sf_dir):
    old = view(spark, sf_dir).select("doc_id", "slug", "title")
    new = old.where("doc_id % 5 = 0").select("slug", "title", F.explode(F.array(F.lit(2), F.lit(3))).alias("v"))
    new = new.select("slug", F.concat("title", F.lit(" v"), F.col("v")).alias("title"), "v")
    return A.upsert(old.select("slug", "title"), new, "slug", "v").select("slug", "title")


@register("pending_migrations", f"WITH {sql.ARTICLES} SELECT slug, version, name FROM art, (VALUES (1, 'schema_version'), (2, 'lifecycle and sensitivity'), (3, 'keyword tiers')) m(version, name) WHERE doc_id % 4 < version")
def pending_migrations(spark, sf_dir):
    return A.pending(view(spark, sf_dir).withColumn("schema_version", (F.col("doc_id") % 4).cast("int")))


@register("skill_catalog", f"WITH {sql.ARTICLES}, s AS (SELECT *, 'skill ' || doc_id % 40 AS name, CASE type WHEN 'procedure' THEN 3 WHEN 'process' THEN 2 WHEN 'help' THEN 1 END AS rank FROM art WHERE type IN ('procedure', 'process', 'help')) SELECT name, slug, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id % 2, slug) AS r FROM s) WHERE r = 1")
def skill_catalog(spark, sf_dir):
    rows = view(spark, sf_dir).withColumn("name", F.concat(F.lit("skill "), F.col("doc_id") % 40)).withColumn("layer", F.col("doc_id") % 2)
    return A.skill_catalog(rows, {"procedure": 3, "process": 2, "help": 1}).select("name", "slug", "rank")


@register("recent_articles", f"WITH {sql.ARTICLES} SELECT slug, retrieval_count FROM art ORDER BY retrieval_count DESC, slug LIMIT 10")
def recent_articles(spark, sf_dir):
    return view(spark, sf_dir).orderBy(F.desc("retrieval_count"), "slug").limit(10).select("slug", "retrieval_count")


@register("article_page", f"WITH {sql.ARTICLES} SELECT slug FROM art ORDER BY slug LIMIT 50 OFFSET 50")
def article_page(spark, sf_dir):
    return view(spark, sf_dir).select("slug").orderBy("slug").offset(50).limit(50)


@register("rendered_articles", f"WITH {sql.ARTICLES} SELECT slug, '---' || chr(10) || 'slug: ' || slug || chr(10) || 'title: ' || title || chr(10) || 'type: ' || type || chr(10) || '---' || chr(10) || chr(10) || body || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || '- [[doc-0]] (see-also)' ELSE '' END AS markdown FROM art")
def rendered_articles(spark, sf_dir):
    link = F.struct(F.lit("doc-0").alias("slug"), F.lit("see-also").alias("type"))
    rows = view(spark, sf_dir).withColumn("related", F.when(F.col("doc_id") % 2 == 0, F.array(link)).otherwise(F.array().cast("array<struct<slug:string,type:string>>")))
    return A.rendered(rows)


@register("file_extract", "SELECT doc_id, len(text) // 4 AS token_estimate, 'base' AS fallback_type, doc_id || '-my-file' AS slug FROM documents")
def file_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_My file.TXT"))
    return docs.select("doc_id", F.floor(F.length("text") / 4).cast("long").alias("token_estimate"), F.lit("base").alias("fallback_type"), text.slug_from_filename(name).alias("slug"))
