"""Sources and sinks: tables written in a format and read back, and files as rows."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import lifecycle as LC
from quillspark.plans import sql
from quillspark.plans.article_queries import rendered_articles, view
from quillspark.plans.misc_queries import bibtex
from quillspark.plans.registry import ORACLES, register
from quillspark.session import reach_workers, scratch, table
from quillspark.sources import files, tables


@register("source_csv", "SELECT * FROM part")
def source_csv(spark, sf_dir):
    at = scratch(spark, "csv")
    table(spark, sf_dir, "part").write.csv(at, header=True)
    found = tables.read_csv(spark, at)
    return found.withColumn("p_size", F.col("p_size").cast("int"))


@register("source_csv_types", "SELECT * FROM (VALUES ('p_brand', 'string'), ('p_name', 'string'), ('p_partkey', 'bigint'), ('p_retailprice', 'double'), ('p_size', 'bigint'), ('p_type', 'string')) v(name, kind)")
def source_csv_types(spark, sf_dir):
    at = scratch(spark, "csv")
    table(spark, sf_dir, "part").write.csv(at, header=True)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in tables.read_csv(spark, at).schema], "name string, kind string")


@register("source_orc", "SELECT * FROM supplier")
def source_orc(spark, sf_dir):
    at = scratch(spark, "orc")
    table(spark, sf_dir, "supplier").write.orc(at)
    return tables.read_orc(spark, at)


@register("source_append", "SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_acctbal < 0")
def source_append(spark, sf_dir):
    at = scratch(spark, "appended")
    rows = table(spark, sf_dir, "customer")
    tables.append(rows, at)
    tables.append(rows.where("c_acctbal < 0"), at)
    return tables.read_parquet(spark, at)


@register("source_sqlite", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_sqlite(spark, sf_dir):
    """A dump of the nations, run into a SQLite file, and its table read by ranges. The file has to be on a mounted folder."""
    at = urlparse(scratch(spark, "sqlite")).path + ".db"
    cells = F.format_string("(%d, '%s', %d)", "n_nationkey", F.replace("n_name", F.lit("'"), F.lit("''")), "n_regionkey")
    values = ", ".join(r[0] for r in table(spark, sf_dir, "nation").select(cells).collect())  # 25 rows
    tables.import_dump(f"CREATE TABLE nation (n_nationkey SERIAL, n_name TEXT, n_regionkey INTEGER); INSERT INTO nation VALUES {values};", at)
    return tables.read_sqlite(spark, at)["nation"].select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@register("source_edges", "SELECT CAST(n_regionkey AS VARCHAR) AS source, n_name AS target, CAST(n_nationkey AS VARCHAR) AS k FROM nation")
def source_edges(spark, sf_dir):
    at = scratch(spark, "edges")
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("From"), F.col("n_name").alias("TO")).write.csv(at, header=True)
    return files.read_edges(spark, at)


@register("source_graph_json", "SELECT 'n' || n_nationkey AS node_id, n_name AS name, 'r' || n_regionkey AS region FROM nation")
def source_graph_json(spark, sf_dir):
    """A graph document of the nations (25 rows) and its tables."""
    at = scratch(spark, "graph")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), "n_name", F.concat(F.lit("r"), "n_regionkey").alias("r"))
    nodes, edges = F.collect_list(F.struct("id", F.col("n_name").alias("name"))), F.collect_list(F.struct(F.col("r").alias("source"), F.col("id").alias("target")))
    n.agg(F.to_json(F.struct(nodes.alias("nodes"), edges.alias("links"))).alias("value")).coalesce(1).write.text(at)
    nodes, edges = files.read_graph_json(spark, at)
    return nodes.join(edges.select(F.col("target").alias("node_id"), F.col("source").alias("region")), "node_id").select("node_id", F.get_json_object("attrs", "$.name").alias("name"), "region")


@register("source_arff", "SELECT p_brand AS label, CAST(p_size AS DOUBLE) || '|' || p_retailprice AS features FROM part")
def source_arff(spark, sf_dir):
    at = scratch(spark, "arff")
    spark.createDataFrame([("@relation parts\n@attribute size numeric\n@data",)], "value string").coalesce(1).write.text(at)
    table(spark, sf_dir, "part").select(F.concat_ws(",", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), "p_brand").alias("value")).write.mode("append").text(at)
    return files.read_arff(spark, at).select("label", F.array_join(F.transform("features", lambda x: x.cast("string")), "|").alias("features"))


@register("source_lines", "WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS line FROM nation) SELECT line, n_name AS value, TRUE AS truncated FROM n WHERE line BETWEEN 4 AND 8")
def source_lines(spark, sf_dir):
    at = scratch(spark, "lines")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).coalesce(1).sortWithinPartitions("value").write.text(at)
    return files.read_lines(spark, at, 4, 5)


@register("source_newest", "SELECT '/n/' || page_id || CASE page_id % 4 WHEN 0 THEN '.tex' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' ELSE '.png' END AS path FROM pages WHERE page_id % 4 < 3 AND page_id % 10 <> 9 ORDER BY page_id DESC LIMIT 1")
def source_newest(spark, sf_dir):
    i = F.col("page_id")
    folder = F.when(i % 10 == 9, "/.hidden/").otherwise("/n/")
    ext = F.element_at(F.array(*map(F.lit, (".tex", ".md", ".txt", ".png"))), (i % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(F.concat(folder, i, ext).alias("path"), i.alias("modificationTime"))
    return files.newest(rows).select("path")


@register("source_blobs", "SELECT page_id, 'p' || page_id || '.pdf' AS name, length(html) AS size, 'application/pdf' AS mime, 'blob-' || page_id || '-20240102030405.pdf' AS stored FROM pages")
def source_blobs(spark, sf_dir):
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("/b/p"), i, F.lit(".pdf")).alias("path"), F.length("html").alias("length"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modificationTime"))
    found = files.described(rows).withColumn("page_id", F.regexp_extract("name", r"\d+", 0).cast("long"))
    return found.select("page_id", "name", "size", "mime", files.stored_name(F.concat(F.lit("blob-"), "page_id"), F.col("modificationTime"), F.lit(".pdf")).alias("stored"))


@register("source_articles", f"WITH {sql.ARTICLES} SELECT slug, type, body_words, 'current' AS lifecycle, CAST(0.8 AS DOUBLE) AS confidence FROM art")
def source_articles(spark, sf_dir):
    """Articles as rendered, read back from their front matter and body."""
    rows = rendered_articles(spark, sf_dir).select(F.concat(F.lit("/a/"), "slug", F.lit(".md")).alias("path"), F.col("markdown").alias("value"))
    return files.parsed_articles(rows).select("slug", "type", F.col("body_words").cast("int").alias("body_words"), "lifecycle", "confidence")


@register("source_skills", r"SELECT 'skill-' || p_partkey AS slug, p_name AS description, 'first|second|third' AS steps FROM part")
def source_skills(spark, sf_dir):
    i = F.col("p_partkey")
    value = F.concat(F.lit("---\nname: Skill "), i, F.lit("\ndescription: "), "p_name", F.lit("\ntags: [a, b]\n---\n# Steps\n1. first\n2. second\n3. third\n"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("/s/"), i, F.lit("/SKILL.md")).alias("path"), value.alias("value"))
    return files.parsed_skills(rows).select("slug", "description", F.array_join("steps", "|").alias("steps"))


@register("source_spill", "SELECT doc_id, md5(text) AS digest, coalesce(length(text) > 4000, FALSE) AS spilled FROM documents")
def source_spill(spark, sf_dir):
    """Long texts moved to a side table and found again by their locators."""
    at = scratch(spark, "spill")
    short, long = files.spilled(table(spark, sf_dir, "documents"), "doc_id", "text", "s1")
    long.write.parquet(at)
    back = short.join(spark.read.parquet(at), "locator", "left")
    return back.select("doc_id", F.md5(F.coalesce("full_text", "text").cast("binary")).alias("digest"), F.col("locator").isNotNull().alias("spilled"))


@register("source_bibtex", r"SELECT regexp_extract(entry, '@(\w+)', 1) AS kind, regexp_extract(entry, '\{([^,]+),', 1) AS key, count(*) AS entries FROM (" + ORACLES["bibtex"] + ") GROUP BY 1, 2")
def source_bibtex(spark, sf_dir):
    at = scratch(spark, "bibtex")
    files.write_bibtex(bibtex(spark, sf_dir), at)
    entries = spark.read.text(at).where("value LIKE '@%'")
    return entries.groupBy(F.regexp_extract("value", r"@(\w+)", 1).alias("kind"), F.regexp_extract("value", r"\{([^,]+),", 1).alias("key")).agg(F.count(F.lit(1)).alias("entries"))


@register("source_vectors", "SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def source_vectors(spark, sf_dir):
    at = scratch(spark, "vectors")
    LC.save_vectors(table(spark, sf_dir, "embeddings"), at)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(at).select("vec_id", F.size("embedding").alias("dims"), F.round(total, 4).alias("total"))


@register("source_tables", "SELECT * FROM (VALUES ('listed', TRUE), ('dropped', TRUE), ('again', FALSE)) v(step, result)")
def source_tables(spark, sf_dir):
    name = "kept_" + scratch(spark, "t").rsplit("-", 1)[1]
    tables.save_table(table(spark, sf_dir, "region"), name)
    steps = [("listed", name in tables.user_tables(spark)), ("dropped", tables.drop_table(spark, name)), ("again", tables.drop_table(spark, name))]
    return spark.createDataFrame(steps, "step string, result boolean")


@register("source_scenes", "SELECT p_partkey, 2 AS meshes, p_size + 7 AS vertices, 3 AS faces FROM part")
def source_scenes(spark, sf_dir):
    scene = F.concat(F.lit('{"meshes":[{"primitives":[{"attributes":{"POSITION":1}},{"attributes":{}}]},{"primitives":[{"attributes":{"POSITION":0}}]}],"accessors":[{"count":'), "p_size", F.lit('},{"count":7}]}'))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("/m/"), "p_partkey", F.lit(".gltf")).alias("path"), scene.cast("binary").alias("content"))
    return files.scene_counts(rows).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("p_partkey"), "meshes", "vertices", "faces")


@register("source_models", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size * 3 END AS vertices, p_size AS faces FROM part")
def source_models(spark, sf_dir):
    """OBJ files with a line for every vertex and face, and STL files in text form."""
    i, n = F.col("p_partkey"), F.col("p_size")
    body = F.when(i % 2 == 0, F.concat(F.repeat(F.lit("v 1 2 3\n"), n), F.repeat(F.lit("f 1 2 3\n"), n))).otherwise(F.concat(F.lit("solid x\n"), F.repeat(F.lit("facet normal 0 0 1\n"), n)))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("/m/"), i, F.when(i % 2 == 0, ".obj").otherwise(".stl")).alias("path"), body.cast("binary").alias("content"))
    return files.model_counts(rows).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("p_partkey"), "vertices", "faces")


@register("html_views", f"WITH {sql.ARTICLES} SELECT slug, '<h1>' || title || '</h1>' || chr(10) || '<ul>' || chr(10) || '<li>' || type || '</li>' || chr(10) || '<li><a href=\"/article/' || slug || '\">' || slug || '</a></li>' || chr(10) || '</ul>' || chr(10) || '<h2>Words</h2>' || chr(10) || '<ol>' || chr(10) || '<li>' || body_words || '</li>' || chr(10) || '</ol>' AS html FROM art")
def html_views(spark, sf_dir):
    rows = view(spark, sf_dir)
    page = F.concat(F.lit("# "), "title", F.lit("\n\n- "), "type", F.lit("\n- [["), "slug", F.lit("]]\n## Words\n1. "), F.col("body_words").cast("string"))
    return rows.select("slug", text.html_body(page).alias("html"))


@register("source_documents", "SELECT n_nationkey, 'First line of ' || n_name || chr(10) || chr(10) || 'Region ' || n_regionkey AS text FROM nation")
def source_documents(spark, sf_dir):
    """A DOCX file for every nation (25 rows) and the paragraphs in it."""
    import io
    import zipfile

    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def docx(*paragraphs: str) -> bytes:
        out = io.BytesIO()
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    rows = [(r["n_nationkey"], docx(f"First line of {r['n_name']}", "", f"Region {r['n_regionkey']}")) for r in table(spark, sf_dir, "nation").collect()]
    reach_workers(spark)
    return spark.createDataFrame(rows, "n_nationkey int, content binary").select("n_nationkey", files.document_text(F.col("content")).alias("text"))
