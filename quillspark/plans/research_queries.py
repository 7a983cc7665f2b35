"""Rewrites, research steps and batch ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import articles as A
from quillspark.operators import linking as L
from quillspark.operators import research as R
from quillspark.operators import rewrites as RW
from quillspark.plans import sql
from quillspark.plans.article_queries import view
from quillspark.plans.registry import register
from quillspark.session import saved, table, texts


# whole texts with phrases of every kind put before and behind them
_HEAD, _TAIL = "moreover, it is clear that this demonstrates a crucial point . ", " We leverage it and  delve deeper. They are here. In conclusion, it is statistically significant."
_planted = f"'{_HEAD}' || coalesce(text, '') || '{_TAIL}'"


def planted(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.concat(F.lit(_HEAD), F.coalesce("text", F.lit("")), F.lit(_TAIL)).alias("text"))


def _vocabulary_sql(x: str) -> str:
    for phrase in sorted(RW.SUBSTITUTIONS, key=len, reverse=True):
        to, p = RW.SUBSTITUTIONS[phrase], phrase.replace("'", "''")
        x = f"regexp_replace({x}, '\\b{p[0].upper()}(?i:{p[1:]})\\b', '{to.capitalize()}', 'g')"
        x = f"regexp_replace({x}, '\\b(?i:{p})\\b', '{to}', 'g')"
    for pattern, to in ((" {2,}", " "), (" ,", ","), (r" \.", "."), (r"\.\.+", "."), (r",\s*,", ","), (r"\.,\s", ". "), (r"(?i)\b(practically|statistically|clinically|economically)(\s+)large\b", r"\1\2significant"), (r"(?i)\b(statistical)(\s+)large\b", r"\1\2significance"), (" {2,}", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


@register("rewrite_vocabulary", f"SELECT doc_id, upper(r[1:1]) || r[2:] AS rewritten FROM (SELECT doc_id, {_vocabulary_sql(_planted)} AS r FROM documents)")
def rewrite_vocabulary(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", RW.vocabulary(F.col("text")).alias("rewritten"))


def _contracted(s: str) -> str:
    for phrase, to in RW.CONTRACTIONS.items():
        to = to.replace("'", "''")
        s = f"regexp_replace({s}, '(?i)\\b{phrase}\\b', '{to}')"
    return s


@register(
    "rewrite_contractions",
    f"""WITH s AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 2) AS l FROM (SELECT doc_id, {_planted} AS t FROM documents))
SELECT doc_id, CASE WHEN len(l) < 3 THEN t ELSE array_to_string(list_transform(l, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN regexp_replace(CASE WHEN (i - 1) % 2 = 0 THEN {_contracted('x')} ELSE x END, 'do not', 'don''t') WHEN (i - 1) % 3 = 1 THEN regexp_replace(CASE WHEN (i - 1) % 2 = 0 THEN {_contracted('x')} ELSE x END, 'cannot', 'can''t') ELSE CASE WHEN (i - 1) % 2 = 0 THEN {_contracted('x')} ELSE x END END), ' ') END AS rewritten FROM s""",
)
def rewrite_contractions(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", RW.contractions(F.col("text")).alias("rewritten"))


def _tone(s: str, i: str, n: str) -> str:
    """SQL of the tone of the sentence s with the place i from 0 of n."""
    words = lambda x: f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
    low = lambda x: f"(lower({x}[1:1]) || {x}[2:])"
    some = lambda x, values: "(" + " OR ".join(f"contains(lower({x}), '{v}')" for v in values) + ")"
    first = f"(CASE WHEN {i} = 1 AND {words(s)} > 5 AND NOT regexp_matches({s}, '(?i)(^|[^\\pL\\pN_])(I|we|my|our)($|[^\\pL\\pN_])') THEN 'I think ' || {low(s)} ELSE {s} END)"
    second = f"(CASE WHEN {i} = {n} // 2 AND {words(s)} > 8 AND NOT {some(first, RW.DOUBT)} THEN regexp_replace({first}, '\\.+$', '') || ', though this may not hold in all cases.' ELSE {first} END)"
    return f"(CASE WHEN {i} = {n} - 1 AND {words(s)} > 5 AND {words(second)} > 6 AND NOT {some(second, RW.TURNS)} AND regexp_matches(lower({second}), '^({'|'.join(RW.OPENERS)})') THEN 'Still, ' || {low(second)} ELSE {second} END)"


@register(
    "rewrite_tone",
    f"""WITH s AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 2) AS l FROM (SELECT doc_id, {_planted} AS t FROM documents)),
e AS (SELECT doc_id, t, len(l) AS n, unnest(l) AS x, unnest(range(len(l))) AS i FROM s WHERE len(l) >= 3)
SELECT doc_id, string_agg({_tone('x', 'i', 'n')}, ' ' ORDER BY i) AS rewritten FROM e GROUP BY doc_id UNION ALL SELECT doc_id, t FROM s WHERE len(l) < 3""",
)
def rewrite_tone(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", RW.tone(F.col("text")).alias("rewritten"))


@register("rewrite_scores")
def rewrite_scores(spark, sf_dir):
    from quillspark.plans.stat_queries import PHRASES

    return RW.sweep_scores(texts(spark, sf_dir), spark.createDataFrame(PHRASES, "word string, category string, ratio string"))


_stops = ", ".join(f"'{w}'" for w in text.KEYWORD_STOPS)
_first = "list_transform(list_filter(list_transform(range(1, len(k) + 1), lambda i: struct_pack(i := i, w := k[i])), lambda x: list_position(k, x.w) = x.i), lambda x: x.w)[1:8]"


@register(
    "batch_ingest",
    f"""WITH {sql.KEYWORDS}, ks8 AS (SELECT doc_id, {_first} AS ks FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z]{{4,}}'), lambda w: w NOT IN ({_stops})) AS k FROM documents)),
rn AS (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents),
w AS (SELECT doc_id, unnest(ks) AS kw FROM ks8 JOIN rn USING (doc_id) WHERE r = 1), ow AS (SELECT doc_id, count(*) AS own FROM w GROUP BY 1), sz AS (SELECT doc_id AS art, count(*) AS size FROM kw GROUP BY 1),
sh AS (SELECT w.doc_id, kw.doc_id AS art, count(*) AS shared FROM w JOIN kw ON w.kw = kw.kw GROUP BY 1, 2), nr AS (SELECT sh.doc_id, CAST(shared AS DOUBLE) / least(size, own) AS ratio, shared FROM sh JOIN sz USING (art) JOIN ow ON ow.doc_id = sh.doc_id),
b AS (SELECT doc_id, max(struct_pack(ratio := ratio, shared := shared)) AS b FROM nr GROUP BY 1)
SELECT doc_id, CASE WHEN r > 1 THEN 'duplicate' WHEN len(trim(text)) < 500 THEN 'rejected' WHEN b.ratio > 0.6 AND b.shared >= 3 THEN 'skipped' WHEN b.ratio > 0.4 THEN 'review' ELSE 'ingested' END AS outcome FROM rn LEFT JOIN b USING (doc_id)""",
)
def batch_ingest(spark, sf_dir):
    docs = texts(spark, sf_dir)
    kw = A.keywords(docs).groupBy("doc_id").agg(F.collect_list("kw").alias("keywords")).withColumnRenamed("doc_id", "slug")
    return R.ingested(docs.select("doc_id", "text"), kw, name="doc_id").select("doc_id", "outcome")


@register(
    "report_validation",
    "SELECT conv_id, turn, turn % 5 <> 4 AND role IS NOT NULL AND text IS NOT NULL AND turn % 5 <> 3 AND turn % 5 <> 2 AS valid FROM conversations",
)
def report_validation(spark, sf_dir):
    """Turns as reports: known and unknown statuses, a field left out, and texts that are no JSON."""
    kind = F.col("turn") % 5
    status = F.when(kind == 0, "complete").when(kind == 1, "blocked").when(kind == 2, "odd").otherwise("continue")
    doc = F.to_json(F.struct(status.alias("status"), F.substring("text", 1, 2000).alias("summary"), F.when(kind != 3, F.col("role")).alias("evidence")))
    doc = F.when(kind == 4, F.concat(F.lit("not json "), F.coalesce("text", F.lit("")))).otherwise(doc)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.size(R.report_errors(doc)) == 0).alias("valid"))


@register(
    "tier_migration",
    f"WITH {sql.TIERS} SELECT doc_id, count(*) AS keywords, count(*) FILTER (WHERE tier = 'subject') AS subjects, TRUE AS kept_all FROM tier GROUP BY doc_id",
)
def tier_migration(spark, sf_dir):
    """Keywords moved to tiers, with the check that none is lost."""
    docs = texts(spark, sf_dir)
    kw = saved(A.keywords(docs))  # ten short rows a document, read four times
    tiered = L.tiers(kw, L.frequencies(kw, docs))
    before = kw.groupBy("doc_id").agg(F.array_sort(F.collect_set("kw")).alias("_before"))
    after = tiered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("keywords"), F.sum((F.col("tier") == "subject").cast("int")).alias("subjects"), F.array_sort(F.collect_set("kw")).alias("_after"))
    return after.join(before, "doc_id").select("doc_id", "keywords", "subjects", (F.col("_before") == F.col("_after")).alias("kept_all"))


@register("body_store", f"WITH {sql.ARTICLES} SELECT slug, len(body) AS chars, doc_id % 7 = 0 AS missing FROM art")
def body_store(spark, sf_dir):
    """Bodies in a table of their own, and the articles whose body is not there."""
    rows = view(spark, sf_dir)
    bodies = rows.where("doc_id % 7 <> 0").select("slug", F.col("body").alias("_stored"))
    return rows.join(bodies, "slug", "left").select("slug", F.length("body").alias("chars"), F.col("_stored").isNull().alias("missing"))
