"""Queries that apply the text and bibliography functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import biblio, text
from quillspark.operators import jsondocs as J
from quillspark.operators import lifecycle as LC
from quillspark.plans.misc_queries import _titles
from quillspark.plans.registry import register
from quillspark.session import table, texts
from quillspark.sources import files


def docs(spark, sf_dir):
    return texts(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))


_docs = "d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)"
_unique = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"


@register("file_names", r"SELECT page_id, translate(lower(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '')), ' _', '--') AS slug, regexp_replace(url, '[^a-zA-Z0-9._-]', '-', 'g')[1:80] AS safe FROM pages")
def file_names(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.slug_from_filename(files.file_name(u)).alias("slug"), text.safe_filename(u).alias("safe"))


@register("skill_slugs", f"WITH {_docs}, s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, lang || '_' || source AS u FROM d) SELECT doc_id, CASE WHEN s = '' THEN 'skill' ELSE s END AS slug, regexp_full_match(u, '[a-z0-9]+(-[a-z0-9]+)*') AS valid FROM s")
def skill_slugs(spark, sf_dir):
    given = F.concat(F.coalesce("lang", F.lit("")), F.lit("_"), F.coalesce("source", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", text.slug_from_name(F.col("text")).alias("slug"), text.valid_slug(given).alias("valid"))


@register("normal_keywords", f"WITH {_docs}, k AS (SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda x: lower(trim(x))), lambda x: x <> '') AS k FROM d) SELECT doc_id, array_to_string({_unique.format('k')}, '|') AS keywords FROM k")
def normal_keywords(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.normal_keywords(F.split("text", r"\. ")), "|").alias("keywords"))


@register(
    "skill_keywords",
    f"""WITH {_docs}, n AS (SELECT doc_id, list_concat([lower(lang), lower(source)], list_filter(regexp_split_to_array(lower(source || ' ' || lang), '[^a-z0-9]+'), lambda w: len(w) > 2)) AS n, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: len(w) > 3) AS m FROM d),
u AS (SELECT doc_id, {_unique.format('n')} AS u, m FROM n), a AS (SELECT doc_id, u, list_concat(u, m) AS a FROM u) SELECT doc_id, array_to_string((CASE WHEN len(u) < 3 THEN {_unique.format('a')} ELSE u END)[1:8], ',') AS keywords FROM a""",
)
def skill_keywords(spark, sf_dir):
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.skill_keywords(F.array(lang, source), F.concat(source, F.lit(" "), lang), F.col("text")), ",").alias("keywords"))


_TAIL = "\n\n## Acceptance Criteria\n- [ ] first of them\n- [x] second\n3. third\n\n## Related\n- [[doc-1]]\n## Notes\nWhat is said here.\n\nThe very last paragraph of this article is long enough to be its outcome."
_tail = " || chr(10) || ".join(f"'{x}'" for x in _TAIL.split("\n"))


@register(
    "body_parts",
    rf"""WITH {_docs}, b AS (SELECT doc_id, text || {_tail} AS body FROM d), i AS (SELECT doc_id, body, regexp_extract_all(body, '(?m)^\s*(?:\d+[.)]|[-*])\s+(.+)$', 1) AS items FROM b)
SELECT doc_id, 'first of them|second|third' AS criteria, 'What is said here.' || chr(10) || chr(10) || 'The very last paragraph of this article is long enough to be its outcome.' AS notes, 'The very last paragraph of this article is long enough to be its outcome.' AS outcome,
md5(replace(body, chr(10) || '## Related' || chr(10) || '- [[doc-1]]', '')) AS without_related, array_to_string(list_transform(items[1:30], lambda s: trim(s)[1:300]), '|') AS steps,
len(list_filter(string_split(body, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') <> '')) AS paragraphs FROM i""",
)
def body_parts(spark, sf_dir):
    b = F.col("body")
    rows = docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit(_TAIL)).alias("body"))
    return rows.select(
        "doc_id", F.array_join(text.criteria(b), "|").alias("criteria"), text.section(b, "Notes").alias("notes"), text.last_paragraph(b).alias("outcome"), F.md5(text.without_related(b).cast("binary")).alias("without_related"), F.array_join(text.listed_steps(b), "|").alias("steps"), text.paragraphs(b).alias("paragraphs")
    )


@register("truncated_texts", f"WITH {_docs}, h AS (SELECT doc_id, text, text[1:200] AS h, instr(reverse(text[1:200]), ' ') AS p FROM d) SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN p > 0 AND length(h) - p > 100 THEN h[1:length(h) - p] || '...' ELSE h || '...' END AS shown FROM h")
def truncated_texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.smart_truncate(F.col("text"), 200).alias("shown"))


@register("file_sizes", "WITH s AS (SELECT page_id, length(html) * length(html) // 97 AS n FROM pages) SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / CAST(1024 AS DOUBLE) + 0.5) / 10) ELSE printf('%.1f MB', floor(n * 10 / CAST(1048576 AS DOUBLE) + 0.5) / 10) END AS size FROM s")
def file_sizes(spark, sf_dir):
    n = F.floor(F.length("html").cast("long") * F.length("html") / 97)
    return table(spark, sf_dir, "pages").select("page_id", text.human_size(n).alias("size"))


@register("exact_replacements", f"WITH {_docs}, n AS (SELECT doc_id, text, (length(text) - length(replace(text, ' the ', ''))) // 5 AS n FROM d) SELECT doc_id, CASE WHEN n = 1 THEN replace(text, ' the ', ' one ') END AS single, CASE WHEN n >= 1 THEN replace(text, ' the ', ' one ') END AS every FROM n")
def exact_replacements(spark, sf_dir):
    t, old, new = F.col("text"), F.lit(" the "), F.lit(" one ")
    return docs(spark, sf_dir).select("doc_id", text.exact_replace(t, old, new).alias("single"), text.exact_replace(t, old, new, True).alias("every"))


@register("paper_links", r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || page_id || '/pdf/' ELSE url END AS pdf, '\cite{' || 'k' || page_id || ',k' || (page_id + 1) || '}' AS cite FROM pages")
def paper_links(spark, sf_dir):
    i = F.col("page_id")
    u = F.when(i % 2 == 0, F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), i, F.lit("/full?x=1"))).otherwise(F.col("url"))
    key = lambda n: F.concat(F.lit("k"), n)
    return table(spark, sf_dir, "pages").select("page_id", text.pmc_pdf(u).alias("pdf"), biblio.cite_command(F.array(key(i), key(i + 1))).alias("cite"))


@register("paper_titles", f"WITH {_docs}, l AS (SELECT doc_id, list_filter(list_transform(string_split(CASE doc_id % 3 WHEN 0 THEN 'http://example.org/a/very/long/address/of/a/paper' || chr(10) || 'DOI 10.1000/a.long.enough.identifier.here' || chr(10) ELSE '' END || text, chr(10))[1:20], lambda x: trim(x)), lambda x: length(x) > 30 AND NOT starts_with(lower(x), 'http') AND NOT starts_with(lower(x), 'doi')) AS l FROM d) SELECT doc_id, l[1] AS title FROM l")
def paper_titles(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, "http://example.org/a/very/long/address/of/a/paper\nDOI 10.1000/a.long.enough.identifier.here\n").otherwise("")
    return docs(spark, sf_dir).select("doc_id", biblio.title_from_text(F.concat(head, "text")).alias("title"))


def _latex_sql(x: str) -> str:
    x = f"replace({x}, '\\', chr(1))"
    for plain, escaped in biblio.ESCAPES:
        x = f"replace({x}, '{plain}', '{escaped}')"
    return f"replace({x}, chr(1), '\\textbackslash{{}}')"


@register("author_lists", f"SELECT p_partkey, CASE WHEN length(p_name) - length(replace(p_name, ' ', '')) = 1 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) ELSE p_name END || ' and Roe, Jane and Doe et al.' AS authors, p_name || ' key' AS first_key, {_latex_sql('''p_name || ' & 50% of _x_ {a} #2 $1 ~ ^ \\ ' || p_type''')} AS latex FROM part WHERE length(p_name) - length(replace(p_name, ' ', '')) = 1")
def author_lists(spark, sf_dir):
    name = F.col("p_name")
    rows = table(spark, sf_dir, "part").where(F.length("p_name") - F.length(F.replace(name, F.lit(" "), F.lit(""))) == 1)
    title = F.concat(name, F.lit(" & 50% of _x_ {a} #2 $1 ~ ^ \\ "), "p_type")
    return rows.select("p_partkey", biblio.authors_text(F.array(name, F.lit("Roe, Jane"), F.lit("Doe et al."))).alias("authors"), F.concat(name, F.lit(" key")).alias("first_key"), biblio.latex(title).alias("latex"))


@register("author_year_keys", "SELECT o_orderkey, regexp_extract(o_orderpriority, '[^- ]+$') || year(o_orderdate) AS cite_key FROM orders")
def author_year_keys(spark, sf_dir):
    name = F.concat(F.lit("Ann B. "), F.element_at(F.split("o_orderpriority", "-"), 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", biblio.author_year_key(F.array(name, F.lit("Roe, J")), F.year("o_orderdate")).alias("cite_key"))


@register(
    "note_citations",
    """WITH k AS (SELECT doc_id, 'doc-' || doc_id AS slug, CASE doc_id % 4 WHEN 0 THEN 'Adams' WHEN 1 THEN 'Conti' WHEN 2 THEN 'Smith' END AS author, CASE doc_id % 4 WHEN 0 THEN 2000 + doc_id % 20 WHEN 1 THEN 2000 + doc_id % 20 WHEN 2 THEN 1990 + doc_id % 30 END AS year,
CASE doc_id % 4 WHEN 0 THEN 'On item ' || doc_id WHEN 1 THEN 'Item ' || doc_id WHEN 2 THEN 'Item ' || doc_id ELSE 'item ' || doc_id END AS title, CASE WHEN doc_id % 5 < 2 THEN '10.1000/x.' || doc_id END AS doi FROM documents),
b AS (SELECT *, coalesce(author, 'Anon') || coalesce(CAST(year AS VARCHAR), '') AS base FROM k WHERE author IS NOT NULL OR doi IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY slug) AS n FROM b)
SELECT slug, author, year, title, doi, base || CASE WHEN n = 1 THEN '' WHEN n <= 27 THEN chr(CAST(95 + n AS INT)) ELSE 'Ite' END AS cite_key FROM r""",
)
def note_citations(spark, sf_dir):
    i = F.col("doc_id")
    rows = _titles(docs(spark, sf_dir)).withColumn("slug", F.concat(F.lit("doc-"), i))
    rows = rows.withColumn("summary", F.when(i % 5 == 0, F.concat(F.lit("see 10.1000/x."), i, F.lit(". there"))).otherwise("")).withColumn("body", F.when(i % 5 == 1, F.concat(F.lit("text 10.1000/x."), i)).otherwise(""))
    return LC.citations(rows).select("slug", "author", "year", "title", "doi", "cite_key")


@register("json_words", r"""SELECT event_id, trim(regexp_replace(props, '[{}\[\]",:]+', ' ', 'g'))[1:2000] AS words, to_json(list_sort(list_distinct([event_type, 'all', event_type]))) AS listed FROM events""")
def json_words(spark, sf_dir):
    listed = J.list_text(F.array("event_type", F.lit("all"), "event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", J.flattened(F.col("props")).alias("words"), listed.alias("listed"))
    return rows.select("event_id", "words", J.list_text(J.list_from(F.col("listed"))).alias("listed"))


@register("front_fields", "SELECT doc_id, 'doc-' || doc_id AS slug, lang, '' AS missing FROM documents WHERE lang IS NOT NULL")
def front_fields(spark, sf_dir):
    raw = F.concat(F.lit("slug: doc-"), F.col("doc_id"), F.lit("\ntitle: lang: no\nlang:  "), F.col("lang"), F.lit(" \nbody: "), F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]+", " "))
    rows = texts(spark, sf_dir).where("lang IS NOT NULL").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", *[text.field(F.col("raw"), n).alias(n) for n in ("slug", "lang", "missing")])
