"""String, bibliography and set queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import biblio, risk, scores, text
from quillspark.plans.registry import register
from quillspark.session import table, texts


def docs(spark, sf_dir):
    return texts(spark, sf_dir)


@register("doi_extract", "SELECT doc_id, '10.' || (1000 + doc_id) || '/abc.' || doc_id AS doi, '2101.' || lpad(CAST(doc_id % 10000 AS VARCHAR), 5, '0') AS arxiv FROM documents")
def doi_extract(spark, sf_dir):
    i = F.col("doc_id")
    t = F.concat(F.col("text"), F.lit(" see doi: 10."), i + 1000, F.lit("/abc."), i, F.lit(". and arXiv:2101."), F.lpad((i % 10000).cast("string"), 5, "0"), F.lit("v3 end"))
    return docs(spark, sf_dir).select("doc_id", biblio.doi(t).alias("doi"), biblio.arxiv(t).alias("arxiv"))


def _titles(d):
    i = F.col("doc_id")
    return d.select("doc_id", F.when(i % 4 == 0, F.concat(F.lit("Adams et al. "), 2000 + i % 20, F.lit(" — On item "), i)).when(i % 4 == 1, F.concat(F.lit("Conti & Moroni ("), 2000 + i % 20, F.lit(") - Item "), i)).when(i % 4 == 2, F.concat(F.lit("Smith "), 1990 + i % 30, F.lit(" Item "), i)).otherwise(F.concat(F.lit("item "), i)).alias("title"))


@register(
    "title_parse",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Adams' WHEN 1 THEN 'Conti' WHEN 2 THEN 'Smith' END AS author, CASE doc_id % 4 WHEN 0 THEN 2000 + doc_id % 20 WHEN 1 THEN 2000 + doc_id % 20 WHEN 2 THEN 1990 + doc_id % 30 ELSE 0 END AS year, CASE doc_id % 4 WHEN 0 THEN 'On item ' || doc_id WHEN 1 THEN 'Item ' || doc_id WHEN 2 THEN 'Item ' || doc_id ELSE 'item ' || doc_id END AS title FROM documents",
)
def title_parse(spark, sf_dir):
    t = F.col("title")
    return _titles(docs(spark, sf_dir)).select("doc_id", biblio.title_author(t).alias("author"), F.coalesce(biblio.title_year(t), F.lit(0)).alias("year"), biblio.clean_title(t).alias("title"))


@register(
    "cite_keys",
    """WITH k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Adams' || (2000 + doc_id % 20) WHEN 1 THEN 'Conti' || (2000 + doc_id % 20) WHEN 2 THEN 'Smith' || (1990 + doc_id % 30) END AS base, 'Ite' AS past FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM k WHERE base IS NOT NULL)
SELECT doc_id, base || CASE WHEN n = 1 THEN '' WHEN n <= 27 THEN chr(CAST(95 + n AS INT)) ELSE past END AS cite_key FROM r""",
)
def cite_keys(spark, sf_dir):
    rows = _titles(docs(spark, sf_dir))
    base = F.concat(biblio.title_author(F.col("title")), biblio.title_year(F.col("title")))
    rows = rows.select("doc_id", "title", base.alias("base")).where("base IS NOT NULL")  # titles without an author or a year have no key
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("base").orderBy("doc_id")))
    return rows.select("doc_id", biblio.cite_key(F.col("base"), F.col("n"), biblio.clean_title(F.col("title"))).alias("cite_key"))


@register(
    "bibtex",
    """SELECT doc_id, '@' || CASE WHEN doc_id % 2 = 0 THEN 'article' ELSE 'inproceedings' END || '{key' || doc_id || ',' || chr(10) || '  author = {Moroni, Davide and Conti et al.},' || chr(10) || '  title = {A \\& B \\_ ' || doc_id || '},' || chr(10)
|| CASE WHEN doc_id % 2 = 0 THEN '  journal = {Journal of Things},' ELSE '  booktitle = {Proceedings of Things},' END || chr(10) || '  year = {' || (2000 + doc_id % 20) || '},' || chr(10) || '  note = {research-note: doc-' || doc_id || '},' || chr(10) || '}' AS entry FROM documents""",
)
def bibtex(spark, sf_dir):
    i = F.col("doc_id")
    place = F.when(i % 2 == 0, "Journal of Things").otherwise("Proceedings of Things")
    e = biblio.entry(F.concat(F.lit("key"), i), F.array(F.lit("Davide Moroni"), F.lit("Conti et al.")), F.concat(F.lit("A & B _ "), i), place, (2000 + i % 20).cast("int"), F.lit(None).cast("string"), F.concat(F.lit("doc-"), i))
    return docs(spark, sf_dir).select("doc_id", e.alias("entry"))


ACTIONS = ("ls -la", "rm -rf build", "git push origin main --force", "DROP TABLE users", "edit file", "find . -delete", "git status", "sudo rm -rf /", "delete from t", "pytest", "rm --dir old", "truncate logs", "chmod 777 /etc/x", ":(){ :|:& };:", "dd if=a of=/dev/sda", "python3 -c 'import shutil; shutil.rmtree(p)'")
_listed = ", ".join("'" + a.replace("'", "''") + "'" for a in ACTIONS)
_rules = " ".join(f"WHEN regexp_matches(action, '{pattern}') THEN {tier}" for tier, pattern in risk.RULES)


@register("risk_tiers", f"WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN coalesce(text, '') || ' ; ' ELSE '' END || [{_listed}][CAST((conv_id + turn) % {len(ACTIONS)} + 1 AS INT)] || CASE WHEN turn % 3 = 1 THEN ' ' || coalesce(text, '') ELSE '' END AS action FROM conversations) SELECT conv_id, turn, CASE {_rules} ELSE {risk.DEFAULT} END AS tier FROM a")
def risk_tiers(spark, sf_dir):
    """Commands before, after and without the text of a turn."""
    body, turn = F.coalesce("text", F.lit("")), F.col("turn")
    command = F.element_at(F.array(*map(F.lit, ACTIONS)), ((F.col("conv_id") + turn) % len(ACTIONS) + 1).cast("int"))
    action = F.concat(F.when(turn % 3 == 0, F.concat(body, F.lit(" ; "))).otherwise(""), command, F.when(turn % 3 == 1, F.concat(F.lit(" "), body)).otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", risk.risk_tier(action).alias("tier"))


@register("slugs", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower(text), '[^a-z0-9\\s-]', '', 'g'), ' ', '-')[1:50], '-+', '-', 'g'), '^-+', ''), '-+$', '') AS slug FROM documents")
def slugs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.slug_from_question(F.col("text")).alias("slug"))


@register("keyword_extract", f"SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(k) + 1), lambda i: struct_pack(i := i, w := k[i])), lambda x: list_position(k, x.w) = x.i), lambda x: x.w)[1:8], ',') AS keywords FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z]{{4,}}'), lambda w: w NOT IN ({', '.join(repr(w) for w in text.KEYWORD_STOPS)})) AS k FROM documents)")
def keyword_extract(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.extracted_keywords(F.col("text")), ",").alias("keywords"))


@register("research_plan", f"SELECT item_id, {' || chr(10) || '.join(f'''('{a}' || text[1:80] || '{b}')''' for a, b in text.SUB_QUESTIONS)} AS questions FROM benchmark")
def research_plan(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.sub_questions(F.col("text")), "\n").alias("questions"))


@register("claim_relations", f"SELECT doc_id, CASE WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in text.CONTRADICT_WORDS)} THEN 'contradicts' WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in text.EXTEND_WORDS)} THEN 'extends' ELSE 'confirms' END AS relation FROM (SELECT doc_id, lower(text) || CASE WHEN doc_id % 3 = 0 THEN ' also' WHEN doc_id % 3 = 1 THEN ' however' ELSE '' END AS t FROM documents)")
def claim_relations(spark, sf_dir):
    claim = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " also").when(F.col("doc_id") % 3 == 1, " however").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", text.relationship(claim).alias("relation"))


@register("grammar_flags", "WITH f AS (SELECT doc_id, text, regexp_replace(text, '  +', ' ', 'g') AS x FROM documents), s AS (SELECT doc_id, text, x, list_transform(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''))) AS n FROM f) SELECT doc_id, len(regexp_extract_all(text, '  +')) AS double_spaces, len(regexp_extract_all(x, '\\.[A-Z]')) AS missing_spaces, len(list_filter(n, lambda k: k > 60)) AS long_sentences FROM s")
def grammar_flags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.grammar_flags(F.col("text")).alias("g")).select("doc_id", "g.double_spaces", "g.missing_spaces", "g.long_sentences")


@register("spill_preview", "SELECT doc_id, CASE WHEN len(text) > 4000 THEN text[1:500] || '… [truncated ' || (len(text) - 500) || ' chars]' ELSE text END AS shown, len(text) > 4000 AS spilled FROM documents")
def spill_preview(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.when(F.length(t) > 4000, text.preview(t, 500)).otherwise(t).alias("shown"), (F.length(t) > 4000).alias("spilled"))


@register("backoff", "SELECT l_orderkey, l_linenumber, least(2.0::DOUBLE * pow(2.0::DOUBLE, l_linenumber - 1), 60.0::DOUBLE) AS delay FROM lineitem")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.backoff_seconds(F.col("l_linenumber")).alias("delay"))


@register("slug_collisions", "SELECT DISTINCT lang || '-' || doc_id % 50 AS slug FROM documents WHERE doc_id % 8 = 3 INTERSECT SELECT lang || '-' || doc_id % 50 FROM documents WHERE doc_id % 8 = 1")
def slug_collisions(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.concat("lang", F.lit("-"), F.col("doc_id") % 50).alias("slug"))
    return d.where("doc_id % 8 = 3").select("slug").intersect(d.where("doc_id % 8 = 1").select("slug"))


@register("new_files", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def new_files(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").select("page_id").join(known, "page_id", "left_anti")


@register("metric_labels", "WITH v AS (SELECT doc_id, round(CAST(len(text) AS DOUBLE) / greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 1), 1) AS m FROM documents) SELECT doc_id, m, CASE WHEN m BETWEEN 4.2 AND 5.5 AND m BETWEEN 4.5 AND 5.8 THEN 'overlap' WHEN m BETWEEN 4.2 AND 5.5 THEN 'human' WHEN m BETWEEN 4.5 AND 5.8 THEN 'ai' WHEN abs(m - CAST(4.85 AS DOUBLE)) < abs(m - CAST(5.15 AS DOUBLE)) THEN 'human' ELSE 'ai' END AS label FROM v")
def metric_labels(spark, sf_dir):
    m = F.round(F.length("text") / F.greatest(text.word_count(F.col("text")), F.lit(1)), 1)
    return docs(spark, sf_dir).select("doc_id", m.alias("m")).withColumn("label", scores.metric_label(F.col("m"), (4.2, 5.5), (4.5, 5.8)))


@register("inbox_routes", "SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'archive' WHEN url LIKE '%?%' THEN 'rejected' ELSE 'projects' END AS route FROM pages")
def inbox_routes(spark, sf_dir):
    from quillspark.sources.files import routed

    rules = [(F.col("url").like("%.html"), "archive"), (F.col("url").like("%?%"), "rejected")]
    return table(spark, sf_dir, "pages").select("page_id", routed(rules, "projects").alias("route"))
