"""Files that are written here, read back."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, tables


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv_types(spark, tmp_path):
    path = put(tmp_path / "b.csv", 'scientific_name,family,population,ratio\n"Pica, pica",Corvidae,42,3.5\nx,y,oops\n')
    df = tables.read_csv(spark, path)
    assert dict(df.dtypes) == {"scientific_name": "string", "family": "string", "population": "bigint", "ratio": "double"}
    assert [tuple(r) for r in df.collect()] == [("Pica, pica", "Corvidae", 42, 3.5), ("x", "y", None, None)]
    assert tables.read_csv(spark, put(tmp_path / "n.csv", "1,a\n2,b\n"), header=False).count() == 2
    with pytest.raises(ValueError):
        tables.read_csv(spark, put(tmp_path / "e.csv", "a,b\n"))


def test_type_guesses():
    assert [tables.guessed_type(*x) for x in (("42", "count"), ("3.14", "ratio"), ("hello", "name"), ("2024", "year"), ("1.234", "latitude"), ("1_000", "x"), ("nan", "x"))] == ["INTEGER", "REAL", "TEXT", "INTEGER", "REAL", "INTEGER", "REAL"]


def test_columnar_round_trip(spark, tmp_path):
    df = spark.range(2500).withColumn("x", F.col("id") * 1.5)
    df.write.orc(str(tmp_path / "o"))
    tables.append(df, str(tmp_path / "p"))
    assert tables.read_orc(spark, str(tmp_path / "o")).count() == tables.read_parquet(spark, str(tmp_path / "p")).count() == 2500
    assert [tables.legacy_type(f.dataType) for f in df.schema] == ["INTEGER", "REAL"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE birds (id INTEGER, name TEXT, w REAL)")
        c.executemany("INSERT INTO birds VALUES (?, ?, ?)", [(k, f"b{k}", k / 2) for k in range(101)] + [("odd", None, None)])
        c.execute("CREATE TABLE other (x TEXT)")
    found = tables.read_sqlite(spark, path, "bird")
    assert list(found) == ["birds"] and found["birds"].count() == 102
    assert found["birds"].where("id IS NULL").count() == 1 and found["birds"].agg(F.sum("w")).first()[0] == 2525.0
    assert tables.read_sqlite(spark, path)["other"].count() == 0
    with pytest.raises(sqlite3.OperationalError):
        tables.sqlite_tables(str(tmp_path / "missing.db"))
    assert not (tmp_path / "missing.db").exists()


def test_dump(tmp_path):
    sql = "CREATE EXTENSION postgis; CREATE TABLE s (id SERIAL, ok BOOLEAN, at GEOGRAPHY(POINT, 4326)); INSERT INTO s VALUES (1, 1, ST_GeogFromText('POINT(1 2)')), (2, 0, NULL);"
    assert tables.import_dump(sql, str(tmp_path / "d.db")) == {"s": 2}
    with pytest.raises(sqlite3.Error):
        tables.import_dump("NOT SQL", str(tmp_path / "e.db"))


def test_sql_guard(spark):
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) DELETE FROM a", "-- SELECT\nDROP TABLE x"):
        with pytest.raises(ValueError):
            tables.assert_select(bad)
    tables.assert_select("SELECT ';' AS x; ")
    assert tables.read_only_sql(spark, "SELECT id FROM {t} WHERE id > ?", [995], tables={"t": spark.range(1000)}).count() == 4
    assert tables.read_only_sql(spark, "SELECT id FROM {t}", tables={"t": spark.range(1000)}).count() == 500


def test_catalog(spark):
    tables.save_table(spark.range(3), "my_table")
    assert "my_table" in tables.user_tables(spark) and tables.drop_table(spark, "my_table") and not tables.drop_table(spark, "my_table")


def test_articles(spark, tmp_path):
    put(tmp_path / "a" / "one.md", "---\ntitle: One\ntype: help\nkeywords: [A, b]\nsubject_keywords: [a, c]\nconfidence: high\n---\nBody words here.\n\n## Related\n- [[x]]\n")
    put(tmp_path / "a" / "two.yaml", "slug: two-slug\ntitle: Two\n")
    put(tmp_path / "a" / "bad.md", "---\n: : [\n---\nx")
    put(tmp_path / "a" / "none.md", "no front matter")
    got = {r["slug"]: r for r in files.read_articles(spark, str(tmp_path / "a")).collect()}
    assert set(got) == {"one", "two-slug"}
    one = got["one"]
    assert (one["confidence"], one["keywords"], one["subject_keywords"], one["body_words"], one["type"]) == (0.8, ["a", "b"], ["c"], 3, "help")


def test_blobs_and_models(spark, tmp_path):
    put(tmp_path / "m" / "cube.obj", "v 0 0 0\n" * 8 + "f 1 2 3\n" * 12)
    put(tmp_path / "m" / "b.stl", b"\0" * 80 + struct.pack("<I", 700) + b"\0" * 50)
    put(tmp_path / "m" / "t.stl", "solid x\nfacet normal 0 0 1\nfacet normal 0 0 1\n")
    raw = spark.read.format("binaryFile").load(str(tmp_path / "m"))
    got = {r["path"].rsplit("/", 1)[-1]: (r["vertices"], r["faces"]) for r in files.model_counts(raw).collect()}
    assert got == {"cube.obj": (8, 12), "b.stl": (2100, 700), "t.stl": (6, 2)}
    blobs = {r["name"]: r["mime"] for r in files.read_blobs(spark, str(tmp_path / "m")).collect()}
    assert blobs["cube.obj"] == "model/obj"


def test_texts_and_lines(spark, tmp_path):
    put(tmp_path / "x" / "My note.txt", "First, step 1.\nb\nc")
    put(tmp_path / "x" / "empty.md", " ")
    got = {r["slug"]: r for r in files.read_texts(spark, str(tmp_path / "x")).collect()}
    assert got["my-note"]["suggested_type"] == "process" and got["empty"]["error"] == "empty"
    page = files.read_lines(spark, str(tmp_path / "x" / "My note.txt"), offset=2, most=1).collect()
    assert [(r["line"], r["value"], r["truncated"]) for r in page] == [(2, "b", True)]
    newest = files.newest(spark.read.format("binaryFile").load(str(tmp_path / "x"))).collect()
    assert len(newest) == 1


def test_edges_and_graphs(spark, tmp_path):
    e = files.read_edges(spark, put(tmp_path / "e.csv", "from,to,year\na,b,2020\nb,c,2021\n"))
    assert e.columns == ["source", "target", "year"] and e.count() == 2
    nodes, edges = files.read_graph_json(spark, put(tmp_path / "g.json", '{"nodes":[{"id":"a","x":1},{"node_id":"b"}],"links":[{"source":"a","target":"b"}]}'))
    assert {r["node_id"] for r in nodes.collect()} == {"a", "b"} and edges.count() == 1
    assert files.read_json_docs(spark, str(tmp_path / "g.json")).first()["slug"] == "g"


def test_arff_and_skills(spark, tmp_path):
    rows = files.read_arff(spark, put(tmp_path / "a.arff", "@relation x\n@data\n1.0,2.5,pos\n% c\n3,x,neg\n")).orderBy("pos").collect()
    assert [(r["label"], r["features"]) for r in rows] == [("pos", [1.0, 2.5]), ("neg", [3.0, None])]
    put(tmp_path / "s" / "SKILL.md", "---\nname: Deploy App\ndescription: ships the service\ntags: [ci, cd]\n---\n1. build\n2. test\n3. ship\n\n" + "z" * 45)
    s = files.read_skills(spark, str(tmp_path / "s")).first()
    assert s["slug"] == "deploy-app" and s["steps"] == ["build", "test", "ship"] and s["keywords"][:2] == ["ci", "cd"] and s["outcome"] == "z" * 45


def test_spill_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 5000), (2, "short")], "id long, t string")
    shown, side = files.spilled(df, "id", "t", "s1")
    assert side.first()["full_text"] == "x" * 5000 and shown.where("locator IS NOT NULL").first()["t"].endswith("[truncated 4500 chars]")
    files.write_bibtex(spark.createDataFrame([("@misc{a}",), (None,)], "entry string"), str(tmp_path / "bib"))
    assert spark.read.text(str(tmp_path / "bib")).where("value <> ''").count() == 1
    files.write_markdown(spark.createDataFrame([("a", "# A")], "slug string, markdown string"), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).first()["slug"] == "a"
    queue = spark.createDataFrame([("f1", "pending"), ("f2", "done")], "filepath string, status string")
    assert [r["path"] for r in files.unqueued(spark.createDataFrame([("f1",), ("f2",)], "path string"), queue).collect()] == ["f2"]


def test_documents_and_scenes(spark, tmp_path):
    import json
    import struct
    import zipfile
    import zlib

    from quillspark.functions import text

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ ET")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + page + b"\nendstream\nendobj\n")
    (tmp_path / "bad.docx").write_bytes(b"zz")
    found = {r["slug"]: (r["text"], r["error"]) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert found == {"a": ("Hello world\n\nSecond", None), "b": ("Hello (PDF)\nworld", None), "bad": (None, "no extractor")}
    scene = json.dumps({"meshes": [{"primitives": [{"attributes": {"POSITION": 1}}, {"attributes": {}}]}, {"primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": [{"count": 5}, {"count": 7}]}).encode()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.gltf").write_bytes(scene)
    (tmp_path / "m" / "y.glb").write_bytes(b"glTF" + struct.pack("<III", 2, 20 + len(scene), len(scene)) + b"JSON" + scene + b"\0\0\0\0")
    (tmp_path / "m" / "z.gltf").write_text("{}")
    counts = files.scene_counts(spark.read.format("binaryFile").load(str(tmp_path / "m"))).collect()
    assert sorted(tuple(r)[1:] for r in counts) == [(0, 0, 0), (2, 12, 3), (2, 12, 3)]
    page = spark.createDataFrame([("# T\n\np <b> [[x-y]]\n- a\n- b\n1. one\n## S\n",)], "t string").select(text.html_body(F.col("t"))).first()[0]
    assert page == '<h1>T</h1>\n<p>p &lt;b&gt; <a href="/article/x-y">x-y</a></p>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>one</li>\n</ol>\n<h2>S</h2>'


def test_moves_do_not_clobber(spark):
    moves = spark.createDataFrame([("/1/a.md", "arch", "a.md"), ("/2/a.md", "arch", "a.md"), ("/1/b", "rej", "b"), ("/3/c.md", "arch", "c.md")], "path string, folder string, name string")
    taken = spark.createDataFrame([("arch", "a.md"), ("arch", "a-4.md")], "folder string, name string")
    assert {r["path"]: r["stored"] for r in files.unclobbered(moves, taken).collect()} == {"/1/a.md": "a-5.md", "/2/a.md": "a-6.md", "/1/b": "b", "/3/c.md": "c.md"}
