"""Ranking: TF-IDF search and comparison, snippets, vectors, rank fusion."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scores, text
from quillspark.operators.articles import document_counts, document_frequencies, postings, term_counts, with_idf
from quillspark.session import reach_workers, saved

#: Terms of claims that the driver and each task hold at most.
ASKED = 200_000
#: Terms whose IDF the driver and each task hold at most, besides those of one article.
WEIGHED = 200_000


def query_tokens(query: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]{2,}", query.lower()) if t not in set(text.STOP_WORDS)]


def intent(query: str) -> str | None:
    """The kind of document that the first telling word asks for."""
    return next((text.DOC_TYPE_INTENT[t] for t in query_tokens(query) if t in text.DOC_TYPE_INTENT), None)


def search(articles: DataFrame, query: str, k: int = 10, where: Column | None = None, body: str = "body") -> DataFrame:
    """slug and score of the k best articles, by score and slug.

    Two scans and no shuffle of the corpus: how many documents hold each query term (one row), and the scores, of which
    every task keeps its k best. Term counts of a document are row-local. Statistics cover all articles, `where` filters
    the ranked ones only. An article with keywords that contain a query term gets a bonus, as does the intended kind.
    """
    asked = Counter(query_tokens(query))
    if not asked:
        return articles.select("slug", F.lit(0.0).alias("score")).where("false")
    terms = sorted(asked)
    found = articles.select("*", text.tokens(F.col(body)).alias("_tokens"))
    stats = articles.select(text.tokens(F.col(body)).alias("_tokens")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.array_contains("_tokens", t).cast("int")).alias(f"_df{j}") for j, t in enumerate(terms)]
    )
    if where is not None:
        found = found.where(where)
    found = found.where(F.arrays_overlap("_tokens", F.array(*map(F.lit, terms))))
    found = found.withColumn("_max", text.max_count(F.col("_tokens"))).crossJoin(F.broadcast(stats))
    idf = [F.log((F.col("_n") + 1) / (F.col(f"_df{j}") + 1)) + 1 for j in range(len(terms))]

    def times(t: str) -> Column:
        return F.size(F.filter("_tokens", lambda x: x == t))

    parts = [F.lit(asked[t] / max(asked.values())) * idf[j] * (times(t) / F.col("_max")) * idf[j] for j, t in enumerate(terms)]
    score = reduce(lambda a, b: a + b, parts)
    if "keywords" in articles.columns:
        hits = F.size(F.filter("keywords", lambda w: text.contains_any(F.lower(w), terms)))
        score = score * (F.lit(1.0) + hits * 0.3)
    kind = intent(query)
    if kind and "doc_type" in articles.columns:
        score = score * F.when(F.col("doc_type") == kind, 1.5).otherwise(1.0)
    if "lifecycle" in articles.columns:
        score = score * scores.lookup(scores.LIFECYCLE_FACTOR, F.col("lifecycle"), 1.0)
    return found.select("slug", F.round(score, 9).alias("_s")).where("_s > 0").orderBy(F.desc("_s"), "slug").limit(k).select("slug", F.round("_s", 4).alias("score"))


def with_snippets(found: DataFrame, articles: DataFrame, query: str, body: str = "body") -> DataFrame:
    """Snippets for the winners only: their best sentence."""
    some = articles.join(F.broadcast(found), "slug")  # k rows
    return some.select("slug", "score", text.best_sentence(F.col(body), sorted(set(query_tokens(query)))).alias("snippet"))


def compare(articles: DataFrame, slug: str, k: int = 10) -> DataFrame:
    """The k articles most like one, by cosine of TF-IDF vectors.

    An article is weighed within its row, by the WEIGHED commonest terms and the given article's, so no postings are shuffled. The IDF of any other term lies between that of the last of these and that of a term of one
    article, which bounds the norm. Where the bounds leave open whether an article is among the k, its other terms are joined with their frequencies.
    """
    spark, total = articles.sparkSession, articles.agg(F.count(F.lit(1)).alias("n"))
    df = saved(with_idf(document_counts(articles, "body"), total))
    own: dict[str, float] = {}
    held = {}
    for r in postings(articles.where(F.col("slug") == slug), "slug", "body").join(df, "term").collect():  # terms of one article
        own[r["term"]] = own.get(r["term"], 0.0) + r["tf"] / r["max_tf"] * r["idf"]
        held[r["term"]] = r["idf"]
    if not own:
        return articles.select("slug", F.lit(0.0).alias("score")).where("false")
    norm = math.sqrt(sum(w * w for w in own.values()))
    common = df.orderBy(F.desc("df"), "term").limit(WEIGHED + 1).select("term", "idf").collect()
    whole = len(common) <= WEIGHED
    held |= {r["term"]: r["idf"] for r in common[:WEIGHED]}
    at = {t: i for i, t in enumerate(held)}
    idfs, owns = np.array([*held.values(), 0.0]), np.array([*(own.get(t, 0.0) for t in held), 0.0])  # the last is of the terms that are not held

    def weigh(batches):
        for b in batches:
            rows = []
            for body in b.column(1):
                counts = term_counts(body.as_py())
                tf = np.fromiter(counts.values(), np.float64, len(counts)) / max(counts.values(), default=1)
                i = np.fromiter((at.get(t, -1) for t in counts), np.int64, len(counts))
                w = tf * idfs[i]
                rows.append((float((w * owns[i]).sum()), float((w * w).sum()), float((tf[i < 0] ** 2).sum())))
            columns = np.array(rows, np.float64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in columns)], ["slug", "dot", "known", "rest"])

    reach_workers(spark)
    rows = articles.where(F.col("slug") != slug).select("slug", "body").mapInArrow(weigh, "slug string, dot double, known double, rest double")
    rows = rows.groupBy("slug").agg(*(F.sum(c).alias(c) for c in ("dot", "known", "rest"))).where("dot > 0")
    if not whole:
        rows = _settled(saved(rows), articles, df, held, common[-1]["idf"], norm, k)
    out = rows.select("slug", F.round(F.col("dot") / (F.sqrt("known") * norm), 9).alias("_s"))
    return out.orderBy(F.desc("_s"), "slug").limit(k).select("slug", F.round("_s", 4).alias("score"))


def _settled(rows: DataFrame, articles: DataFrame, df: DataFrame, held: dict[str, float], least: float, norm: float, k: int) -> DataFrame:
    """The rows (slug, dot, known, rest) that can be among the k best, with all their terms in `known`; IDFs of terms that are not held are at least `least`."""
    most = df.agg(F.max("idf")).first()[0]
    low, high = (F.col("dot") / (F.sqrt(F.col("known") + F.col("rest") * idf * idf) * norm) for idf in (most, least))
    best = rows.select(low.alias("low")).orderBy(F.desc("low")).limit(k).collect()
    near = rows.where(high >= (best[-1]["low"] if len(best) == k else 0.0) - 2e-9)  # scores are rounded to nine places
    unsettled = near.where("rest > 0").select("slug")
    few = unsettled.limit(ASKED + 1).count() <= ASKED
    some = articles.select("slug", "body").join(F.broadcast(unsettled) if few else unsettled, "slug", "left_semi")
    known = articles.sparkSession.createDataFrame([(t,) for t in held], "term string")
    others = postings(some, "slug", "body").join(F.broadcast(known), "term", "left_anti").join(df.select("term", "idf"), "term")
    w = F.col("tf") / F.col("max_tf") * F.col("idf")
    sums = others.groupBy("slug").agg(F.sum(w * w).alias("_more"))
    return near.join(sums, "slug", "left").withColumn("known", F.col("known") + F.coalesce("_more", F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, query: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and score of the k nearest by inner product; `query` is one row with `q`. Exact, no shuffle but for the k best."""
    sims = vectors.crossJoin(F.broadcast(query)).select(key, F.round(dot(F.col(vector), F.col("q")), 6).alias("score"))
    return sims.orderBy(F.desc("score"), key).limit(k).where("score > 0")


def vector_similar(vectors: DataFrame, to: int, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    query = vectors.where(F.col(key) == to).select(F.col(vector).alias("q"))
    return vector_topk(vectors.where(F.col(key) != to), query, k, key, vector)


def fused(rankings: list[DataFrame], key: str, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank); lists are short."""
    every = reduce(DataFrame.unionByName, [r.select(key, scores.rrf(F.col("rank")).alias("_s")) for r in rankings])
    out = every.groupBy(key).agg(F.round(F.sum("_s"), 9).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(k)


def ranks(found: DataFrame, key: str) -> DataFrame:
    """Rank from 1 by score; `found` is a top-k list."""
    return found.select(key, F.row_number().over(W.orderBy(F.desc("score"), key)).alias("rank"))


def all_terms_like(docs: DataFrame, query: str, k: int = 10, body: str = "full_text", key: str = "slug", snippet: int = 200) -> DataFrame:
    """Documents that contain every term of the query, longest first; `%` and `_` in a term are wildcards."""
    terms = [t for t in re.split(r"[\s,;:]+", query) if len(t) >= 2]
    out = docs
    for t in terms:
        out = out.where(F.col(body).ilike(f"%{t}%"))
    out = out.select(key, F.length(body).alias("char_count"), F.col(body).substr(1, snippet).alias("snippet"))
    return out.orderBy(F.desc("char_count"), key).limit(k)


def best_matches(findings: DataFrame, articles: DataFrame, least: float = 1.0) -> DataFrame:
    """For every finding (finding_id, claim) the article with the highest TF-IDF dot, where it is over `least`.

    Where the terms of all claims are at most ASKED, tasks have them: an article is scored within its row, and only a task's best for each finding is shuffled. Beyond, postings are joined with them.
    """
    said = findings.select("finding_id", F.explode(text.tokens(F.col("claim"))).alias("term")).groupBy("finding_id", "term").count()
    said = said.withColumn("_m", F.max("count").over(W.partitionBy("finding_id")))
    few = said.limit(ASKED + 1).count() <= ASKED
    posted = postings(articles, "slug", "body")
    if few:
        posted = posted.join(F.broadcast(said.select("term").distinct()), "term", "left_semi")
    df = document_frequencies(posted, articles.agg(F.count(F.lit(1)).alias("n")), "slug")
    asked = said.join(df.select("term", "idf"), "term").select("finding_id", "term", (F.col("count") / F.col("_m") * F.col("idf")).alias("_q"), "idf")
    top = W.partitionBy("finding_id").orderBy(F.desc("score"), "slug")
    if few:
        sums = _best_of_tasks(articles, asked)
    else:
        sums = posted.join(asked, "term").groupBy("finding_id", "slug").agg(F.round(F.sum(F.col("tf") / F.col("max_tf") * F.col("idf") * F.col("_q")), 9).alias("score"))
    return sums.withColumn("_r", F.row_number().over(top)).where(f"_r = 1 AND score > {least}").drop("_r")


def _best_of_tasks(articles: DataFrame, asked: DataFrame) -> DataFrame:
    """finding_id, slug, score: each task's best article for each finding."""
    rows = asked.collect()  # at most ASKED
    findings = sorted({r["finding_id"] for r in rows})
    at = {f: i for i, f in enumerate(findings)}
    weights: dict[str, tuple] = {}
    for r in rows:
        where, what = weights.setdefault(r["term"], ([], []))
        where.append(at[r["finding_id"]])
        what.append(r["_q"] * r["idf"])
    weights = {t: (np.array(i), np.array(q)) for t, (i, q) in weights.items()}

    def score(batches):
        stops, tokens = set(text.STOP_WORDS), re.compile("[a-z0-9]{2,}")
        best, whose = np.zeros(len(findings)), [None] * len(findings)
        for b in batches:
            for slug, body in zip(b.column(0).to_pylist(), b.column(1)):
                body = body.as_py()
                counts = Counter(tokens.findall(body.lower())) if body else Counter()
                for w in stops & counts.keys():
                    del counts[w]
                sums, most = np.zeros(len(findings)), max(counts.values(), default=1)
                for t in counts.keys() & weights.keys():
                    i, q = weights[t]
                    sums[i] += counts[t] / most * q
                sums = np.round(sums, 9)
                for i in np.flatnonzero((sums >= best) & (sums > 0)).tolist():
                    if sums[i] > best[i] or slug < whose[i]:
                        best[i], whose[i] = sums[i], slug
        held = [i for i, w in enumerate(whose) if w is not None]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([whose[i] for i in held], pa.string()), pa.array(best[held])], ["_i", "slug", "score"])

    reach_workers(articles.sparkSession)
    kind = asked.schema["finding_id"].dataType.simpleString()
    names = articles.sparkSession.createDataFrame(list(enumerate(findings)), f"_i int, finding_id {kind}")
    return articles.select("slug", "body").mapInArrow(score, "_i int, slug string, score double").join(F.broadcast(names), "_i").select("finding_id", "slug", "score")


def hashed_places(body: Column, dims: int = 64) -> Column:
    """For each token twice its dimension, and one more where its sign is negative."""
    return F.transform(text.tokens(body), lambda x: F.pmod(F.xxhash64(x), F.lit(dims)) * 2 + F.pmod(F.xxhash64(x, F.lit(1)), F.lit(2)))


def hashed_vector(body: Column, dims: int = 64) -> Column:
    """A deterministic embedding without a model: signed hashed token counts, unit length."""
    return hashed_unit(hashed_places(body, dims), dims)


def hashed_unit(places: Column, dims: int = 64) -> Column:
    """Counted in Arrow batches, in one pass over the places; nulls where these are null."""

    def unit(held: pa.Array) -> pa.Array:
        n, none = len(held), np.repeat(held.is_null().to_numpy(zero_copy_only=False), dims)
        rows = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(held), 0).to_numpy())
        counts = np.bincount(rows * (2 * dims) + held.flatten().to_numpy(), minlength=n * 2 * dims).reshape(n, dims, 2)
        v = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.where(norm > 0, v / np.where(norm > 0, norm, 1), v).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(v.ravel(), mask=none))

    return F.arrow_udf(unit, "array<float>")(places)


def claim_citations(claims: DataFrame, articles: DataFrame, least: float = 1.0) -> DataFrame:
    """finding_id, slug, author, year of the research note that a claim is nearest to."""
    from quillspark.functions import biblio

    notes = articles.where("type = 'research-note'")
    best = best_matches(claims, notes, least)
    return best.join(notes.select("slug", "title"), "slug").select("finding_id", "slug", biblio.title_author(F.col("title")).alias("author"), biblio.title_year(F.col("title")).alias("year"))


def source_text(articles: DataFrame) -> Column:
    """What an article is searched by: title, summary, keywords and body; column names of tables, text of blobs, words of JSON."""
    from quillspark.operators.jsondocs import flattened

    have = set(articles.columns)
    part = lambda n: F.coalesce(F.col(n), F.lit("")) if n in have else F.lit("")
    body = part("body")
    if "backend" in have:
        body = F.when(F.col("backend") == "blob", part("extracted_text")).when(F.col("backend") == "json", flattened(part("doc"))).when(F.col("backend") == "sql", part("column_names")).otherwise(body)
    return F.concat_ws(" ", part("title"), part("summary"), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ") if "keywords" in have else F.lit(""), body)
