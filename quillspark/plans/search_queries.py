"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scores, text
from quillspark.operators import articles as A
from quillspark.operators import search as S
from quillspark.plans import sql
from quillspark.plans.article_queries import view
from quillspark.plans.registry import ORACLES, register
from quillspark.session import table, texts

PLAIN = "ing tion er"
GUIDED = "guide ing tion mente"


def _search_sql(query: str, where: str = "TRUE", bonus: str = "CAST(1 AS DOUBLE)", k: int = 10) -> str:
    tokens = S.query_tokens(query)
    most = max(tokens.count(t) for t in tokens)
    values = ", ".join(f"('{t}', CAST({tokens.count(t) / most} AS DOUBLE))" for t in sorted(set(tokens)))
    return f"""WITH {sql.ARTICLES}, {sql.POSTINGS}, q(term, qw) AS (VALUES {values}),
sc AS (SELECT doc_id, sum(qw * idf * (CAST(tf AS DOUBLE) / max_tf) * idf) AS s FROM post JOIN q USING (term) JOIN df USING (term) GROUP BY doc_id),
ss AS (SELECT slug, round(s * {bonus} * CAST({sql.case(scores.LIFECYCLE_FACTOR, 'lifecycle', 1.0)} AS DOUBLE), 9) AS s FROM sc JOIN art USING (doc_id) WHERE {where})
SELECT slug, round(s, 4) AS score FROM ss WHERE s > 0 ORDER BY s DESC, slug LIMIT {k}"""


@register("search_tfidf", _search_sql(PLAIN))
def search_tfidf(spark, sf_dir):
    return S.search(view(spark, sf_dir), PLAIN)


@register("search_filtered", _search_sql(GUIDED, "sensitivity IN ('public', 'internal') AND type <> 'note'", "CAST(CASE doc_type WHEN 'how-to' THEN 1.5 ELSE 1 END AS DOUBLE)"))
def search_filtered(spark, sf_dir):
    keep = scores.access_ok(F.col("sensitivity"), "internal") & (F.col("type") != "note")
    return S.search(view(spark, sf_dir), GUIDED, where=keep)


@register(
    "search_compare",
    f"""WITH {sql.POSTINGS}, w AS (SELECT doc_id, term, CAST(tf AS DOUBLE) / max_tf * idf AS w FROM post JOIN df USING (term)),
o AS (SELECT term, w AS ow FROM w WHERE doc_id = 5), nn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
d AS (SELECT doc_id, sum(w * ow) AS dot FROM w JOIN o USING (term) WHERE doc_id <> 5 GROUP BY doc_id),
s AS (SELECT 'doc-' || doc_id AS slug, round(dot / (norm * (SELECT norm FROM nn WHERE doc_id = 5)), 9) AS s FROM d JOIN nn USING (doc_id))
SELECT slug, round(s, 4) AS score FROM s ORDER BY s DESC, slug LIMIT 10""",
)
def search_compare(spark, sf_dir):
    return S.compare(view(spark, sf_dir), "doc-5")


def _hits(column: str) -> str:
    return " + ".join(f"CAST(contains(lower({column}), '{t}') AS INT)" for t in sorted(set(S.query_tokens(PLAIN))))


@register(
    "search_snippet",
    f"""WITH f AS ({_search_sql(PLAIN)}), p AS (SELECT f.slug, score, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM f JOIN documents d ON f.slug = 'doc-' || d.doc_id),
x AS (SELECT slug, score, parts, unnest(range(1, len(parts) + 1)) AS i FROM p), y AS (SELECT slug, score, parts[i] AS s, row_number() OVER (PARTITION BY slug ORDER BY {_hits('parts[i]')} DESC, i) AS r FROM x)
SELECT slug, score, CASE WHEN len(s) > 150 THEN s[1:150] || '...' ELSE s END AS snippet FROM y WHERE r = 1""",
)
def search_snippet(spark, sf_dir):
    rows = view(spark, sf_dir)
    return S.with_snippets(S.search(rows, PLAIN), rows, PLAIN)


@register("df_idf_top", f"WITH {sql.POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM df ORDER BY df DESC, term LIMIT 50")
def df_idf_top(spark, sf_dir):
    docs = texts(spark, sf_dir)
    df = A.document_frequencies(A.postings(docs), docs.agg(F.count(F.lit(1)).alias("n")))
    return df.orderBy(F.desc("df"), "term").limit(50).select("term", "df", F.round("idf", 6).alias("idf"))


@register("doc_keywords", f"WITH {sql.KEYWORDS} SELECT doc_id, kw FROM kw")
def doc_keywords(spark, sf_dir):
    return A.keywords(texts(spark, sf_dir))


_dot = "list_sum(list_transform(range(1, 65), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"
_vectors = f"SELECT v.vec_id, round({_dot}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q"


@register("vector_topk", f"SELECT * FROM ({_vectors}) WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return S.vector_topk(e, e.where("vec_id = 7").select(F.col("embedding").alias("q")))


@register("vector_similar", f"SELECT * FROM ({_vectors} WHERE v.vec_id <> 7) WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 10")
def vector_similar(spark, sf_dir):
    return S.vector_similar(table(spark, sf_dir, "embeddings"), 7)


@register(
    "hybrid_rrf",
    f"""WITH t AS ({_search_sql(PLAIN, k=20)}), tr AS (SELECT slug, row_number() OVER (ORDER BY score DESC, slug) AS r FROM t),
v AS (SELECT 'doc-' || vec_id AS slug, score FROM ({_vectors}) WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20), vr AS (SELECT slug, row_number() OVER (ORDER BY score DESC, slug) AS r FROM v)
SELECT slug, round(sum(CAST(1 AS DOUBLE) / (60 + r)), 9) AS score FROM (SELECT * FROM tr UNION ALL SELECT * FROM vr) GROUP BY slug ORDER BY score DESC, slug LIMIT 10""",
)
def hybrid_rrf(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    by_text = S.search(view(spark, sf_dir), PLAIN, k=20)
    by_vector = S.vector_topk(e, e.where("vec_id = 7").select(F.col("embedding").alias("q")), k=20).select(F.concat(F.lit("doc-"), F.col("vec_id")).alias("slug"), "score")
    return S.fused([S.ranks(by_text, "slug"), S.ranks(by_vector, "slug")], "slug")


@register("paper_search", "SELECT 'doc-' || doc_id AS slug, len(text) AS char_count, text[1:200] AS snippet FROM documents WHERE text ILIKE '%tion%' AND text ILIKE '%ing%' ORDER BY char_count DESC, slug LIMIT 10")
def paper_search(spark, sf_dir):
    docs = texts(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("slug"), F.col("text").alias("full_text"))
    return S.all_terms_like(docs, "tion, ing").withColumn("char_count", F.col("char_count").cast("long"))


@register("term_snippet", "WITH p AS (SELECT doc_id, text, instr(lower(text), 'tion') AS a FROM documents), b AS (SELECT *, greatest(a - 150, 1) AS lo, least(a + 3 + 150, len(text)) AS hi FROM p) SELECT doc_id, CASE WHEN a > 0 THEN CASE WHEN lo > 1 THEN '…' ELSE '' END || text[lo:hi] || CASE WHEN hi < len(text) THEN '…' ELSE '' END ELSE text[1:300] END AS snippet FROM b")
def term_snippet(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.snippet_around(F.col("text"), F.lit("tion")).alias("snippet"))


@register(
    "finding_matches",
    f"""WITH {sql.POSTINGS}, w AS (SELECT doc_id, term, CAST(tf AS DOUBLE) / max_tf * idf AS w FROM post JOIN df USING (term)),
qt AS (SELECT item_id, unnest({sql.TOKENS}) AS term FROM benchmark), qc AS (SELECT item_id, term, count(*) AS c FROM qt GROUP BY 1, 2),
qm AS (SELECT *, max(c) OVER (PARTITION BY item_id) AS m FROM qc), qq AS (SELECT item_id, term, CAST(c AS DOUBLE) / m * idf AS q FROM qm JOIN df USING (term)),
s AS (SELECT item_id AS finding_id, 'doc-' || doc_id AS slug, round(sum(w * q), 9) AS score FROM w JOIN qq USING (term) GROUP BY item_id, doc_id)
SELECT finding_id, slug, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY score DESC, slug) AS r FROM s) WHERE r = 1 AND score > 1""",
)
def finding_matches(spark, sf_dir):
    found = S.best_matches(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("finding_id"), F.col("text").alias("claim")), view(spark, sf_dir))
    return found.select("finding_id", "slug", F.round("score", 6).alias("score"))


_notes = ORACLES["finding_matches"].replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 8 = 4)")


@register(
    "claim_citations",
    f"SELECT finding_id, slug, CASE CAST(slug[5:] AS BIGINT) % 3 WHEN 0 THEN 'Adams' WHEN 1 THEN 'Conti' END AS author, CASE CAST(slug[5:] AS BIGINT) % 3 WHEN 0 THEN 2000 + CAST(slug[5:] AS BIGINT) % 20 WHEN 1 THEN 1990 + CAST(slug[5:] AS BIGINT) % 20 END AS year FROM ({_notes})",
)
def claim_citations(spark, sf_dir):
    """The research note that a claim is nearest to, and what its title says of author and year."""
    i = F.col("doc_id")
    title = F.when(i % 3 == 0, F.concat(F.lit("Adams et al. "), 2000 + i % 20, F.lit(" — On it"))).when(i % 3 == 1, F.concat(F.lit("Conti "), 1990 + i % 20, F.lit(" On it"))).otherwise("on it")
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("finding_id"), F.col("text").alias("claim"))
    return S.claim_citations(claims, view(spark, sf_dir).withColumn("title", title))
