"""Articles: the view over documents, row checks, migrations, and create / update / delete as DataFrame transforms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import scores, text
from quillspark.session import reach_workers, saved

DOC_TYPES = ("tutorial", "how-to", "reference", "explanation")
KEYWORDS = 10
#: Keywords occur in at least two documents and at most this share.
KEYWORD_SHARE = 0.20
#: Counts that a task holds before it gives them away.
HELD = 50_000
#: Terms whose IDF the driver and each task hold at most.
WEIGHED = 200_000
TERM_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
NO_TERMS = frozenset(text.STOP_WORDS) | set(TERM_CHARACTERS)
#: All other bytes are blanks.
RUNS = bytes(c if chr(c) in TERM_CHARACTERS else 32 for c in range(256))


def pick(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def article_view(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Documents as articles, without keywords (see `keywords`). Row-local but for the labels join."""
    i = F.col("doc_id")
    out = docs.select(
        "doc_id",
        F.concat(F.lit("doc-"), i).alias("slug"),
        F.array_join(F.slice(text.tokens(F.col("text")), 1, 8), " ").alias("title"),
        pick(scores.TYPES, i).alias("type"),
        F.when(i % 10 == 0, "superseded").when(i % 10 == 1, "historical").otherwise("current").alias("lifecycle"),
        pick(("public", "internal", "confidential"), i).alias("sensitivity"),
        pick(DOC_TYPES, i).alias("doc_type"),
        text.word_count(F.col("text")).alias("body_words"),
        (i % 20).alias("retrieval_count"),
        "lang",
        "source",
        F.col("text").alias("body"),
    )
    if labels is None:
        return out.withColumn("confidence", F.lit(0.8))
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("_q"))
    return out.join(known, "doc_id", "left").withColumn("confidence", F.when(F.col("_q") == 1, 0.9).when(F.col("_q") == 0, 0.6).otherwise(0.8)).drop("_q")


def runs(t: str) -> list[str]:
    """Lower-case runs of a-z and 0-9, those of one character too."""
    return t.lower().encode().translate(RUNS).decode().split()


def term_counts(t: str | None) -> Counter:
    """The terms of a text, as `text.tokens` has them, with their counts."""
    found = Counter(runs(t)) if t else Counter()
    for w in NO_TERMS & found.keys():
        del found[w]
    return found


def counted(batches, key: str, keep: Callable[[Counter], dict] = lambda found: found):
    """Record batches (key, term, tf, max_tf) of batches (key, text), of the terms that `keep` leaves: one text at a time, and a bounded number of counts."""
    import pyarrow as pa

    for b in batches:
        rows, terms, counts, tops = [], [], [], []

        def made(b=b):
            out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(tops, pa.int64())], [key, "term", "tf", "max_tf"])
            for x in (rows, terms, counts, tops):
                x.clear()
            return out

        for i, t in enumerate(b.column(1)):
            found = term_counts(t.as_py())
            if found:
                some = keep(found)
                n = len(some)
                rows.extend([i] * n)
                terms.extend(some.keys())
                counts.extend(some.values())
                tops.extend([max(found.values())] * n)
            if len(rows) >= HELD:
                yield made()
        yield made()


def postings(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """key, term, tf, max_tf, counted within the row in Arrow batches, so tokens are not shuffled. Null and empty bodies have none."""
    reach_workers(docs.sparkSession)
    return docs.select(key, body).mapInArrow(lambda batches: counted(batches, key), f"{key} {docs.schema[key].dataType.simpleString()}, term string, tf long, max_tf long")


def document_frequencies(posted: DataFrame, total: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, df, n, idf; `total` is one row with n."""
    return with_idf(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), total)


def with_idf(df: DataFrame, total: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(total)).withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)


def document_counts(docs: DataFrame, body: str = "text") -> DataFrame:
    """term, df. A task sums over its texts and gives its counts away when it holds HELD, so what is shuffled is not a row for each text and term."""
    import pyarrow as pa

    def count(batches):
        held = Counter()

        def made():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "df"])
            held.clear()
            return out

        for b in batches:
            for t in b.column(0):
                held.update(set(runs(t.as_py() or "")) - NO_TERMS)
                if len(held) >= HELD:
                    yield made()
        yield made()

    reach_workers(docs.sparkSession)
    return docs.select(body).mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def keywords(docs: DataFrame, most: int = KEYWORDS, share: float = KEYWORD_SHARE) -> DataFrame:
    """doc_id, kw: the best terms by rounded TF-IDF, then by name.

    Tasks hold the IDF of the WEIGHED commonest terms, so only terms that can be among a row's best leave it; any other term is in fewer texts, and in two at least if it counts, which bounds its IDF.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    every = saved(with_idf(document_counts(docs, "text"), total))
    n = total.first()["n"]
    known = every.orderBy(F.desc("df"), "term").limit(WEIGHED + 1).select("term", "df", "idf").collect()
    counts = lambda df: 2 <= df <= share * n
    idf = {r["term"]: r["idf"] if counts(r["df"]) else -1.0 for r in known[:WEIGHED]}
    posted = strongest(docs, idf, math.log((n + 1) / 3) + 1 if len(known) > WEIGHED else -1.0, most)
    df = every.where((F.col("df") >= 2) & (F.col("df") <= share * F.col("n")))
    scored = posted.join(df, "term").select("doc_id", "term", F.round(F.col("tf") / F.col("max_tf") * F.col("idf"), 9).alias("score"))
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("doc_id", F.col("term").alias("kw"))


def strongest(docs: DataFrame, idf: dict[str, float], rare: float, most: int) -> DataFrame:
    """doc_id, term, tf, max_tf of the terms that can be among the `most` best of their row; others than those of `idf` have at most the IDF `rare`, and terms with a negative one are none."""
    at = {t: i for i, t in enumerate(idf)}
    high = np.array([*idf.values(), rare])
    low = np.maximum(high, 0.0)
    low[-1] = 0.0  # it may be in one text only

    def keep(found: Counter) -> dict[str, int]:
        tf = np.fromiter(found.values(), np.float64, len(found)) / max(found.values())
        i = np.fromiter((at.get(t, -1) for t in found), np.int64, len(found))
        last = np.partition(tf * low[i], -most)[-most] if len(found) >= most else 0.0
        best = (high[i] > 0) & (tf * high[i] >= last - 1e-6)  # scores are rounded
        terms = list(found)
        return {terms[j]: found[terms[j]] for j in np.flatnonzero(best)}

    reach_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: counted(batches, "doc_id", keep), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, tf long, max_tf long")


def list_articles(articles: DataFrame, article_type: str | None = None, keyword: str | None = None, access: str | None = None, doc_type: str | None = None, lifecycle: str | None = None) -> DataFrame:
    """Filters that are given, then by title and slug."""
    out = articles
    for name, value in (("type", article_type), ("doc_type", doc_type), ("lifecycle", lifecycle)):
        if value:
            out = out.where(F.col(name) == value)
    if keyword:
        out = out.where(F.exists("keywords", lambda k: F.lower(k) == keyword.lower()))
    if access:
        out = out.where(scores.access_ok(F.col("sensitivity"), access))
    return out.orderBy("title", "slug")


def checks(articles: DataFrame) -> DataFrame:
    """The rows with `errors`: names of the checks that fail."""
    c = set(articles.columns)
    rules = []

    def rule(needs: str, name: str, bad: Callable[[], Column]) -> None:
        if set(needs.split()) <= c:
            rules.append(F.when(F.coalesce(bad(), F.lit(False)), name))

    col = F.col
    rule("slug", "slug", lambda: ~text.valid_slug(col("slug")))
    rule("title", "title", lambda: ~F.length("title").between(1, 200))
    rule("summary", "summary", lambda: F.length("summary") > 300)
    rule("confidence", "confidence", lambda: ~col("confidence").between(0, 1))
    rule("importance", "importance", lambda: ~col("importance").between(1, 5))
    rule("gap gap_question gap_priority", "gap", lambda: col("gap") & (col("gap_question").isNull() | col("gap_priority").isNull()))
    rule("created_at updated_at", "updated_at", lambda: col("updated_at") < col("created_at"))
    rule("created_at reviewed_at", "reviewed_at", lambda: col("reviewed_at") < col("created_at"))
    rule("updated_at next_review_at", "next_review_at", lambda: col("next_review_at") < col("updated_at"))
    rule("provenance", "provenance", lambda: F.coalesce(F.size("provenance"), F.lit(0)) < 1)
    rule("type", "type", lambda: ~col("type").isin(*scores.TYPES))
    rule("keywords", "few_keywords", lambda: F.size("keywords") < 3)
    return articles.withColumn("errors", F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>"))


def upgraded_related(related: Column, relation: str = "see-also") -> Column:
    """Plain names as (slug, type)."""
    return F.transform(related, lambda s: F.struct(s.alias("slug"), F.lit(relation).alias("type")))


def deduped_tiers(articles: DataFrame) -> DataFrame:
    """Keywords in normal form; one that is in both tiers stays in the article tier."""
    kept = articles.withColumn("keywords", text.normal_keywords(F.col("keywords")))
    return kept.withColumn("subject_keywords", F.array_except(text.normal_keywords(F.col("subject_keywords")), F.col("keywords")))


def upsert(old: DataFrame, new: DataFrame, key: str = "slug", order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; among new rows of one key the last by `order` stays."""
    if order:
        w = W.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def created(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Add articles; a slug that exists is refused unless `overwrite`."""
    if overwrite:
        return upsert(old, new)
    return old.unionByName(new.join(old.select("slug"), "slug", "left_anti"), allowMissingColumns=True)


def updated(old: DataFrame, slug: str, changes: dict[str, Column], at: Column, by: str, note: str) -> DataFrame:
    """Change an article, raise its version and append to its history."""
    hit = F.col("slug") == slug
    out = old
    for name, value in changes.items():
        out = out.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    step = F.struct((F.col("version") + 1).cast("int").alias("v"), at.cast("timestamp").alias("at"), F.lit(by).alias("by"), F.lit(note).alias("note"))
    out = out.withColumn("history", F.when(hit, F.array_append("history", step)).otherwise(F.col("history")))
    return out.withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version")).cast("int"))


def deleted(old: DataFrame, slug: str) -> DataFrame:
    """Drop an article and the links to it."""
    out = old.where(F.col("slug") != slug)
    return out.withColumn("related", F.filter("related", lambda r: r["slug"] != slug)) if "related" in old.columns else out


def counted_read(old: DataFrame, slug: str) -> DataFrame:
    """Reading as an explicit change: one more retrieval."""
    return old.withColumn("retrieval_count", F.col("retrieval_count") + (F.col("slug") == slug).cast("int"))


MIGRATIONS: dict[int, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def migration(version: int, name: str):
    def add(f):
        MIGRATIONS[version] = (name, f)
        return f

    return add


@migration(1, "schema_version")
def _add_version(df: DataFrame) -> DataFrame:
    return df


@migration(2, "lifecycle and sensitivity")
def _add_lifecycle(df: DataFrame) -> DataFrame:
    for name, value in (("lifecycle", "current"), ("sensitivity", "internal"), ("reading_status", "unread")):
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


@migration(3, "keyword tiers")
def _add_tiers(df: DataFrame) -> DataFrame:
    return df if "subject_keywords" in df.columns else df.withColumn("subject_keywords", F.array().cast("array<string>"))


def migrated(articles: DataFrame) -> DataFrame:
    """Every registered migration above a row's schema_version, in order; rows are told by their version afterwards."""
    out = articles if "schema_version" in articles.columns else articles.withColumn("schema_version", F.lit(0))
    for version in sorted(MIGRATIONS):
        out = MIGRATIONS[version][1](out)
        out = out.withColumn("schema_version", F.greatest("schema_version", F.lit(version)))
    return out


def pending(articles: DataFrame) -> DataFrame:
    """slug, version, name of the migrations to come."""
    todo = articles.sparkSession.createDataFrame([(v, n) for v, (n, _) in sorted(MIGRATIONS.items())], "version int, name string")
    return articles.join(F.broadcast(todo), F.coalesce("schema_version", F.lit(0)) < F.col("version")).select("slug", "version", "name")


def rendered(articles: DataFrame) -> DataFrame:
    """slug, markdown: front matter, body and wiki links."""
    links = F.array_join(F.transform("related", lambda r: F.concat(F.lit("- [["), r["slug"], F.lit("]] ("), r["type"], F.lit(")"))), "\n")
    listed = lambda name: F.concat(F.lit(f"{name}: ["), F.array_join(F.col(name), ", "), F.lit("]"))
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{x}: "), F.col(x).cast("string")) for x in ("slug", "title", "type") if x in articles.columns], *[listed(x) for x in ("keywords",) if x in articles.columns], F.lit("---"))
    return articles.select("slug", F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit("")), F.when(F.size("related") > 0, F.concat(F.lit("\n\n## Related\n\n"), links)).otherwise("")).alias("markdown"))


def skill_catalog(articles: DataFrame, ranks: dict[str, int], layer: str = "layer") -> DataFrame:
    """One row a name, a narrower layer before a wider one, by rank and name."""
    ranked = articles.withColumn("rank", scores.lookup(ranks, F.col("type"), 0)).where("rank > 0")
    w = W.partitionBy("name").orderBy(layer, "slug")
    return ranked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy(F.desc("rank"), "name")


def table_page(articles: DataFrame, needle: str = "", equal: dict[str, str] | None = None, order: str = "title", descending: bool = False) -> DataFrame:
    """Rows whose title, slug or keywords contain a text, with equal cells, sorted by a column; missing cells come last."""
    low = F.lower(F.concat_ws(" ", "title", "slug", F.array_join("keywords", " ")))
    out = articles.where(F.contains(low, F.lit(needle.lower())))
    for name, value in (equal or {}).items():
        out = out.where(F.col(name) == value)
    return out.orderBy(F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last(), "slug")


def by_backend(articles: DataFrame, *backends: str) -> DataFrame:
    return articles.where(F.col("backend").isin(*backends))


def review_due(articles: DataFrame, today: Column) -> DataFrame:
    return articles.where(F.col("next_review_at") < today)


def type_counts(articles: DataFrame, column: str = "type") -> DataFrame:
    return articles.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
