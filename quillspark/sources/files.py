"""Files as rows: articles with front matter, blobs, 3-D models, text, logs, ARFF, and the sinks for them."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text
from quillspark.session import reach_workers

MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv",
    "json": "application/json", "html": "text/html", "zip": "application/zip", "mp3": "audio/mpeg", "mp4": "video/mp4", "obj": "model/obj", "stl": "model/stl", "gltf": "model/gltf+json", "glb": "model/gltf-binary",
}
ARTICLE_FIELDS = "slug string, title string, type string, keywords array<string>, subject_keywords array<string>, summary string, lifecycle string, doc_type string, sensitivity string, confidence double, retrieval_count long, importance double"
LISTS = ("keywords", "subject_keywords")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def split_front_matter(files: DataFrame, path: str = "path", body: str = "value") -> DataFrame:
    """path, raw, body: a Markdown file that starts with `---` has its front matter up to the next `---`; of a YAML file all is front
    matter; other files are left out."""
    yaml = extension(F.col(path)).isin("yaml", "yml")
    parts = F.split(F.col(body), "(?m)^---[ \t]*$", 3)
    marked = F.col(body).startswith("---") & (F.size(parts) >= 3)
    return files.where(yaml | marked).select(path, F.when(yaml, F.col(body)).otherwise(F.get(parts, F.lit(1))).alias("raw"), F.when(yaml, "").otherwise(F.trim(F.get(parts, F.lit(2)))).alias("body"))


def _parsed(batches):
    import yaml

    for pdf in batches:
        rows = []
        for path, raw, body in zip(pdf["path"], pdf["raw"], pdf["body"]):
            try:
                fm = yaml.safe_load(raw)
            except yaml.YAMLError:
                continue
            if not isinstance(fm, dict):
                continue
            number = lambda x, default, kind: kind(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else default
            listed = lambda x: [str(v) for v in x] if isinstance(x, list) else []
            said = lambda k, default=None: str(fm[k]) if fm.get(k) is not None else default
            rows.append((said("slug", path.rsplit("/", 1)[-1].rsplit(".", 1)[0]), said("title"), said("type", "base"), listed(fm.get("keywords")), listed(fm.get("subject_keywords")), said("summary"), said("lifecycle", "current"), said("doc_type"), said("sensitivity_label", "internal"), number(fm.get("confidence"), 0.8, float), number(fm.get("retrieval_count"), 0, int), number(fm.get("importance"), None, float), body))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in ARTICLE_FIELDS.split(", ")] + ["body"])


def read_articles(spark: SparkSession, *paths: str) -> DataFrame:
    """Articles of .md and .yaml files, read whole; files that cannot be read as such are left out. YAML has no built-in
    parser, so front matter goes through an Arrow function."""
    return parsed_articles(spark.read.option("recursiveFileLookup", True).text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed_articles(files: DataFrame) -> DataFrame:
    """Articles of rows (path, value)."""
    reach_workers(files.sparkSession)
    found = split_front_matter(files).mapInPandas(_parsed, ARTICLE_FIELDS + ", body string")
    found = found.withColumn("body_words", text.word_count(text.without_related(F.col("body"))))
    return found.withColumn("keywords", text.normal_keywords(F.col("keywords"))).withColumn("subject_keywords", F.array_except(text.normal_keywords(F.col("subject_keywords")), F.col("keywords")))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, mime of the files of a folder; contents are not read."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime"))


def described(found: DataFrame) -> DataFrame:
    """Name, size and type of rows (path, length, modificationTime)."""
    mime = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return found.select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.coalesce(mime[extension(F.col("path"))], F.lit("application/octet-stream")).alias("mime"), "modificationTime")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and code files, and the paragraphs of DOCX and plain PDF files, with format, slug, suggested type and token estimate; empty and unreadable ones have
    an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext, body = extension(F.col("path")), F.decode("content", "UTF-8")
    kind = F.when(ext.isin(*text.TEXT_EXTENSIONS), "text").when(ext.isin(*text.CODE_EXTENSIONS), "code").when(ext == "pdf", "pdf").when(ext.isin("docx", "doc"), "docx").otherwise("other")
    reach_workers(spark)
    body = F.when(ext == "docx", document_text(F.col("content"))).when(ext == "pdf", pdf_text(F.col("content"))).when(ext != "doc", body)
    out = found.select("path", kind.alias("source_format"), text.slug_from_filename(file_name(F.col("path"))).alias("slug"), body.alias("text"))
    readable = F.col("text").isNotNull()
    return out.select("path", "source_format", "slug", F.when(readable, F.col("text")).alias("text"), text.article_type(F.col("text")).alias("suggested_type"), F.floor(F.length("text") / 4).alias("token_estimate"), F.when(~readable, "no extractor").when(F.trim("text") == "", "empty").alias("error"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(StringType())
def document_text(content: pd.Series) -> pd.Series:
    """Paragraphs of DOCX files with a blank line between; null for what is none. A zip archive has no built-in reader."""
    import io
    import zipfile
    from xml.etree import ElementTree

    def one(data):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n"}
        paragraphs = ("".join(t.text or "" if t.tag == f"{_W}t" else marks.get(t.tag, "") for t in p.iter()) for p in body.iter(f"{_W}p"))
        return "\n\n".join(p for p in paragraphs if p.strip())

    return content.map(one)


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|\bT\*|\bT[dDm]\b|\bET\b|['\"](?=\s)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


def page_text(data: bytes) -> str | None:
    """Literal strings shown by the content streams of a PDF, plain or deflated, a line for each move; null if it shows none. Fonts with encodings of their own
    and encrypted files are not read."""
    import zlib

    if not data or not data.startswith(b"%PDF"):
        return None
    pages = []
    for head, body in _STREAM.findall(data):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        out = []
        for m in _SHOWN.finditer(body):
            token = m[0]
            if token.startswith(b"("):
                plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _ESCAPED.get(e[1], e[1]), token[1:-1], flags=re.S)
                out.append(plain.decode("latin-1"))
            else:
                out.append("\n")
        lines = (x.strip() for x in "".join(out).split("\n"))
        pages.append("\n".join(x for x in lines if x))
    return "\n\n".join(p for p in pages if p) or None


@F.pandas_udf(StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    return content.map(page_text)


def scene_counts(files: DataFrame) -> DataFrame:
    """path, meshes, vertices, faces of glTF and GLB contents (binaryFile rows): vertices are those of the POSITION accessors of all primitives, faces the number of
    primitives. A GLB file has its JSON in the first chunk."""
    little = lambda at: reduce(lambda a, b: a + b, [F.conv(F.hex(F.substring("content", at + 1 + k, 1)), 16, 10).cast("long") * (256**k) for k in range(4)])
    ext = extension(F.col("path"))
    doc = F.decode(F.when(ext == "glb", F.substring("content", F.lit(21), little(12).cast("int"))).otherwise(F.col("content")), "UTF-8")
    shape = "struct<meshes:array<struct<primitives:array<struct<attributes:struct<POSITION:int>>>>>,accessors:array<struct<count:long>>>"
    rows = files.where(ext.isin("gltf", "glb")).select("path", F.from_json(doc, shape).alias("s"))
    primitives = F.flatten(F.transform("s.meshes", lambda m: F.coalesce(m["primitives"], F.array().cast("array<struct<attributes:struct<POSITION:int>>>"))))
    count = lambda p: F.coalesce(F.get("s.accessors", p["attributes"]["POSITION"])["count"], F.lit(0))
    vertices = F.aggregate(primitives, F.lit(0).cast("long"), lambda a, p: a + count(p))
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    return rows.select("path", zero(F.when(F.col("s.meshes").isNotNull(), F.size("s.meshes"))).alias("meshes"), zero(vertices).alias("vertices"), zero(F.when(F.col("s.meshes").isNotNull(), F.size(primitives))).alias("faces"))


def unclobbered(moves: DataFrame, taken: DataFrame) -> DataFrame:
    """path, folder, name, stored: files to move into folders, where a name that is taken (folder, name), or that an earlier path takes, gets -1, -2 and so on before its
    extension. The numbers go on from the highest one taken, so none is used twice."""
    ext = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    base = F.col("name").substr(F.lit(1), F.length("name") - F.length(ext))
    parts = lambda df: df.select("*", ext.alias("_e"), base.alias("_b"))
    numbered = taken.select("folder", ext.alias("_e"), base.alias("_b"))
    number = F.regexp_extract("_b", r"-(\d+)$", 1).try_cast("long")
    plain = numbered.select("folder", "_e", "_b", F.lit(0).cast("long").alias("_k"))
    with_number = numbered.where(number.isNotNull()).select("folder", "_e", F.regexp_replace("_b", r"-\d+$", "").alias("_b"), number.alias("_k"))
    top = plain.union(with_number).groupBy("folder", "_e", "_b").agg(F.max("_k").alias("_top"), F.max((F.col("_k") == 0).cast("int")).alias("_there"))
    rows = parts(moves).withColumn("_r", F.row_number().over(W.partitionBy("folder", "name").orderBy("path")) - 1).join(top, ["folder", "_e", "_b"], "left")
    nth = F.col("_r") + F.coalesce("_there", F.lit(0))
    stored = F.when(nth == 0, F.col("name")).otherwise(F.concat("_b", F.lit("-"), (nth + F.coalesce("_top", F.lit(0))).cast("string"), "_e"))
    return rows.select("path", "folder", "name", stored.alias("stored"))


def model_counts(files: DataFrame) -> DataFrame:
    """path, vertices, faces of OBJ and STL contents (binaryFile rows): lines for text forms, the count at byte 80 for binary STL."""
    ext, body = extension(F.col("path")), F.decode("content", "UTF-8")
    solid = F.decode(F.substring("content", 1, 5), "US-ASCII") == "solid"
    binary = reduce(lambda a, b: a + b, [F.conv(F.hex(F.substring("content", 81 + k, 1)), 16, 10).cast("long") * (256**k) for k in range(4)])
    faces = F.when(ext == "obj", F.regexp_count(body, F.lit("(?m)^f "))).when((ext == "stl") & solid, F.regexp_count(body, F.lit("facet normal"))).when(ext == "stl", binary)
    vertices = F.when(ext == "obj", F.regexp_count(body, F.lit("(?m)^v "))).otherwise(faces * 3)
    return files.select("path", vertices.cast("long").alias("vertices"), faces.cast("long").alias("faces"))


def read_lines(spark: SparkSession, path: str, offset: int = 1, most: int = 500) -> DataFrame:
    """line and value from `offset` on, and whether there is more; a page of one file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    page = rows.where((F.col("line") >= offset - 1) & (F.col("line") < offset - 1 + most)).select((F.col("line") + 1).alias("line"), "value")
    total = rows.agg(F.max("line").alias("_last"))
    return page.crossJoin(F.broadcast(total)).select("line", "value", (F.col("_last") >= offset - 1 + most).alias("truncated"))


def newest(files: DataFrame, extensions=("tex", "md", "txt")) -> DataFrame:
    """The newest text file outside hidden folders."""
    return files.where(extension(F.col("path")).isin(*extensions) & ~F.col("path").rlike(r"/\.")).orderBy(F.desc("modificationTime"), "path").limit(1)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """label and features of the rows after `@data`."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"(?is)^.*?@data[^\n]*\n", ""), "\n")).alias("pos", "v"))
    cells = F.split(F.trim("v"), ",")
    rows = lines.where("trim(v) <> '' AND NOT trim(v) LIKE '%\\%%' ESCAPE '\\\\'")
    return rows.select("pos", F.element_at(cells, -1).alias("label"), F.transform(F.slice(cells, 1, F.size(cells) - 1), lambda x: x.try_cast("double")).alias("features"))


def read_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """source, target and other columns of an edge list, whatever its end points are called."""
    raw = spark.read.csv(path, sep=sep, header=True)
    low = {c.lower(): c for c in raw.columns}
    pick = lambda names: next((low[n] for n in names if n in low), None)
    s, t = pick(("source", "from", "src")), pick(("target", "to", "dst"))
    if not s or not t:
        raise ValueError("no source and target columns")
    return raw.select(F.col(s).alias("source"), F.col(t).alias("target"), *[c for c in raw.columns if c not in (s, t)])


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, attrs) and edges (source, target, attrs) of `{nodes, edges | links}`; attributes stay as JSON."""
    doc = spark.read.text(path, wholetext=True)
    items = lambda name: F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")
    nodes = doc.select(F.explode(items("nodes")).alias("attrs")).select(F.coalesce(F.get_json_object("attrs", "$.id"), F.get_json_object("attrs", "$.node_id")).alias("node_id"), "attrs")
    edges = doc.select(F.explode(F.coalesce(items("edges"), items("links"))).alias("attrs")).select(F.get_json_object("attrs", "$.source").alias("source"), F.get_json_object("attrs", "$.target").alias("target"), "attrs")
    return nodes, edges


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    """slug and doc: one JSON document a file."""
    return spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("slug"), F.col("value").alias("doc"))


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """slug, description, keywords, steps, outcome of skill files."""
    return parsed_skills(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed_skills(files: DataFrame) -> DataFrame:
    """Skills of rows (path, value)."""
    f = split_front_matter(files)
    name, description = text.field(F.col("raw"), "name"), text.field(F.col("raw"), "description")
    tags = F.filter(F.split(F.regexp_replace(text.field(F.col("raw"), "tags"), r"[\[\]]", ""), r"\s*,\s*"), lambda t: t != "")
    return f.select(text.slug_from_name(name).alias("slug"), description.alias("description"), text.skill_keywords(tags, name, description).alias("keywords"), text.listed_steps(F.col("body")).alias("steps"), text.last_paragraph(F.col("body")).alias("outcome"))


def unqueued(files: DataFrame, queue: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Files that are not pending or being processed; told apart by path, and by `more` columns of both sides where a path is not one file's."""
    return files.join(queue.where(F.col("status").isin("pending", "processing")).select(F.col("filepath").alias("path"), *more), ["path", *more], "left_anti")


def routed(rules: list[tuple[Column, str]], default: str) -> Column:
    """The destination of the first rule that applies."""
    out = F.lit(default)
    for condition, to in reversed(rules):
        out = F.when(condition, to).otherwise(out)
    return out


def stored_name(slug: Column, at: Column, ext: Column) -> Column:
    """Name of a stored blob: slug, UTC time and extension."""
    return F.concat(slug, F.lit("-"), F.date_format(at, "yyyyMMddHHmmss"), ext)


def spilled(df: DataFrame, key: str, column: str, session: str, most: int = 4000, shown: int = 500) -> tuple[DataFrame, DataFrame]:
    """Rows with long texts shortened and a locator, and the side table of the long texts."""
    long = F.length(column) > most
    at = F.concat(F.lit(f"spill:{session}/"), text.safe_filename(F.col(key).cast("string")))
    return df.withColumn("locator", F.when(long, at)).withColumn(column, F.when(long, text.preview(F.col(column), shown)).otherwise(F.col(column))), df.where(long).select(at.alias("locator"), F.col(column).alias("full_text"))


def write_markdown(rendered: DataFrame, path: str) -> None:
    """One text row an article, split by slug."""
    rendered.select(F.col("markdown").alias("value"), "slug").write.mode("overwrite").partitionBy("slug").text(path)


def write_bibtex(entries: DataFrame, path: str, column: str = "entry") -> None:
    """Entries with a blank line between; a bibliography is one file, and small."""
    entries.where(F.col(column).isNotNull()).select(F.concat(column, F.lit("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
