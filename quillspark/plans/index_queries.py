"""Queries over indexes that are written once into the shared folder and then read: by terms, and by vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import bodystore as B
from quillspark.operators import vectorindex as V
from quillspark.operators.segments import kept_at
from quillspark.operators.textindex import TextIndex
from quillspark.plans import sql
from quillspark.plans.article_queries import view
from quillspark.plans.registry import ORACLES, register
from quillspark.plans.search_queries import PLAIN
from quillspark.session import shared_folder, spread, table, texts


def text_index(spark, sf_dir) -> TextIndex:
    """All articles, by three writes: older versions and articles that go again, then the articles as they are with removals, then a merge. Written once for the same files; a run that stopped is taken up."""
    index = TextIndex(spark, kept_at(shared_folder(spark), "text-index-lists", table(spark, sf_dir, "documents")))
    articles = view(spark, sf_dir)
    old = articles.withColumn("body", F.concat(F.substring("body", 1, 300), F.lit(" earlier words")))
    gone = articles.withColumn("slug", F.concat(F.lit("gone-"), "slug"))
    writes = (lambda: index.upsert(old.unionByName(gone)), lambda: index.upsert(articles, gone.select("slug")), index.merge)
    for write in writes[len(index._log()) :]:
        write()
    return index


@register("index_search", ORACLES["search_tfidf"])
def index_search(spark, sf_dir):
    return text_index(spark, sf_dir).search(PLAIN)


@register("index_terms", f"WITH {sql.POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM df")
def index_terms(spark, sf_dir):
    return text_index(spark, sf_dir).frequencies().select("term", "df", F.round("idf", 6).alias("idf"))


@register("index_holding", f"WITH {sql.POSTINGS} SELECT 'doc-' || doc_id AS slug, CAST(tf AS INT) AS tf FROM tf WHERE term = 'ing'")
def index_holding(spark, sf_dir):
    return text_index(spark, sf_dir).holding("ing")


def vector_index(spark, sf_dir) -> V.VectorIndex:
    """All vectors: the first write holds other versions of them, which the second replaces."""
    vectors = spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = V.VectorIndex(spark, kept_at(shared_folder(spark), "vector-index", table(spark, sf_dir, "embeddings")))
    writes = (lambda: index.build(vectors), lambda: index.upsert(vectors.where("id % 3 = 0").withColumn("vector", F.reverse("vector"))), lambda: index.upsert(vectors.where("id % 3 = 0")))
    for write in writes[len(index._log()) :]:
        write()
    return index


def vector_questions(spark, sf_dir):
    """Every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


_products = "round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 6)"


@register(
    "vector_index_topk",
    f"SELECT qid, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS id, {_products} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10",
)
def vector_index_topk(spark, sf_dir):
    return vector_index(spark, sf_dir).search(vector_questions(spark, sf_dir), exact=True)


@register("vector_index_recall", "SELECT count(*) AS questions, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, sf_dir):
    """Whether the recall at 10 of as many lists as hold 0.95 of the answers to a sample is 0.9 or more, against the exact answers."""
    index, asked = vector_index(spark, sf_dir), vector_questions(spark, sf_dir)
    found = V.recall(index.search(asked, probes=index.probes(0.95)), index.search(asked, exact=True))
    return found.select("questions", (F.col("recall") >= 0.9).alias("enough"))


@register(
    "body_verify",
    "SELECT 'doc-' || doc_id AS slug, CASE WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'changed' END AS state FROM documents WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 UNION ALL SELECT 'new-' || doc_id, 'extra' FROM documents WHERE doc_id % 17 = 0",
)
def body_verify(spark, sf_dir):
    """Bodies kept apart in bucketed tables; some lose a body, some have a letter changed, some have no article."""
    name = f"bodies_{uuid.uuid4().hex}"
    docs = texts(spark, sf_dir).select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("slug"), F.coalesce("text", F.lit("")).alias("body"))
    B.migrate(docs, f"{name}_articles", name)
    changed = docs.where("doc_id % 11 = 0").select("slug", F.concat("body", F.lit("x")).alias("body"))
    extra = docs.where("doc_id % 17 = 0").select(F.concat(F.lit("new-"), "doc_id").alias("slug"), "body")
    B.upsert(spark, name, changed.unionByName(extra))
    B.upsert(spark, name, removed=docs.where("doc_id % 13 = 0").select("slug"))
    return B.verify(spark, f"{name}_articles", name)
