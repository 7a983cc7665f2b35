"""Lifecycle operators on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import lifecycle as C

RELATED = "array<struct<slug:string,type:string>>"


def test_links_and_totals(spark):
    rows = spark.createDataFrame(
        [("a", [("b", "see-also"), ("x", "see-also")], ["c"], True, dt.date(2020, 1, 1), ["k"]), ("b", [("a", "see-also")], ["a"], False, None, ["k", "l"]), ("c", [], [], None, dt.date(2999, 1, 1), [])],
        f"slug string, related {RELATED}, related_pinned array<string>, gap boolean, next_review_at date, keywords array<string>",
    ).withColumn("link_count", F.lit(None).cast("int"))
    assert {r["slug"]: r["links"] for r in C.inbound_links(rows).collect()} == {"a": 1, "b": 1, "c": 1}
    t = C.corpus_totals(rows, F.lit("2024-01-01").cast("date")).first()
    assert (t["articles"], t["gaps"], t["past_review"], t["orphans"], t["avg_keywords"], t["avg_links"]) == (3, 1, 1, 1, 1.0, 1.0)
    assert {r["slug"]: r["warnings"] for r in C.warnings(rows.withColumn("body", F.lit("p\n\n" * 9))).collect()}["a"] == ["few keywords", "long body"]


def test_bodies(spark):
    rows = spark.createDataFrame([("a", "A", "base", "md", "", "text", "f"), ("b", "B", "note", "sql", None, None, "f")], "slug string, title string, type string, backend string, body string, content string, formatted string")
    assert [r["body"] for r in C.with_defaults(rows).orderBy("slug").collect()] == ["", "See the attached data of B."]
    assert [r["body"] for r in C.main_body(rows.drop("body")).orderBy("slug").collect()] == ["text", "f"]


def test_missions_and_skills(spark):
    board = spark.createDataFrame([("m1", "open"), ("m2", "done")], "title string, status string")
    new = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("m3",)], "title string")
    assert {r["title"] for r in C.submitted(board, new).collect()} == {"m2", "m3"}
    skills = spark.createDataFrame([("s", "d", ["k"], ["1"], "o"), ("t", "d", ["k"], ["1"], "o")], "slug string, description string, keywords array<string>, steps array<string>, outcome string")
    assert [r["slug"] for r in C.skills_as_articles(skills, spark.createDataFrame([("s",)], "slug string")).collect()] == ["t"]


def test_task_and_inbox_folds(spark):
    ev = spark.createDataFrame([(1, 1, 10, "research"), (1, 2, 20, "qa_passed"), (2, 1, 5, "qa_passed"), (2, 2, 9, "blocked")], "task_id long, seq long, at long, status string")
    assert {r["task_id"]: (r["status"], r["completed_at"]) for r in C.task_states(ev).collect()} == {1: ("qa_passed", 20), 2: ("blocked", None)}
    steps = {1: ["dequeue", "complete"], 2: ["dequeue", "fail"] * 3, 3: ["dequeue", "fail"], 4: ["dequeue", "fail"] * 3 + ["retry"], 5: ["dequeue"]}
    inbox = spark.createDataFrame([(t, k, kind) for t, kinds in steps.items() for k, kind in enumerate(kinds)], "task_id long, seq long, kind string")
    assert {r["task_id"]: (r["attempts"], r["status"]) for r in C.inbox_states(inbox).collect()} == {1: (1, "completed"), 2: (3, "dead_letter"), 3: (1, "pending"), 4: (0, "pending"), 5: (1, "processing")}


def test_handler_and_tick(spark):
    def handler(row):
        if row["id"] == 2:
            raise ValueError("no")
        return f"done {row['id']}"

    got = {r["id"]: (r["result"], r["error"]) for r in C.handled(spark.createDataFrame([(1,), (2,)], "id long"), handler).collect()}
    assert got == {1: ("done 1", None), 2: (None, "no")}
    board = spark.createDataFrame([(1, "ready", "a", 1, 1, None), (2, "ready", "a", 1, 2, None), (3, "blocked", "b", 1, 1, None), (4, "research", "b", 1, 1, None), (5, "research", "b", 1, 1, None), (6, "qa", "b", 1, 1, 5)], "task_id long, status string, assignee string, priority int, created_at long, parent_id long")
    assert {(r["task_id"], r["action"]) for r in C.tick(board, F.lit(0), 1, 5).collect()} == {(1, "dispatch"), (3, "needs_human"), (4, "decompose")}
    assert C.next_seq(spark.createDataFrame([(4,)], "seq long")).first()[0] == 5


def test_texts(spark):
    t = spark.createDataFrame([(1, 2, 5, "win", None)], "task_id long, round int, most int, objective string, summary string")
    assert C.handoff(t).first()["text"].startswith("Round 2 of 5\nObjective: win\nSo far: -")
    cov = spark.createDataFrame([("m2", "PARTIAL"), ("m1", "PARTIAL"), ("m3", "DOCUMENTED")], "module string, status string")
    assert C.audit_report(cov).first()["report"] == "DOCUMENTED (1): m3\nPARTIAL (2): m1, m2"


def test_slugs_and_citations(spark):
    files = spark.createDataFrame([("x/01_Adams_2017_images.pdf",), ("odd.pdf",)], "path string")
    assert [tuple(r) for r in C.guessed_slugs(files, spark.createDataFrame([("adams-2017-z",), ("adams-2017-a",), ("adams-2018",)], "slug string")).collect()] == [("x/01_Adams_2017_images.pdf", "adams-2017-a")]
    notes = spark.createDataFrame([("s1", "Adams et al. 2017 — One", "(2017, JMLR) text", ""), ("s2", "Adams et al. 2017 — Two", "", "doi 10.1000/xy"), ("s3", "nothing", "", "")], "slug string, title string, summary string, body string")
    got = {r["slug"]: (r["cite_key"], r["journal"], r["doi"]) for r in C.citations(notes).collect()}
    assert got == {"s1": ("Adams2017", "Journal of Machine Learning Research", None), "s2": ("Adams2017a", None, "10.1000/xy")}
    merged = C.merged_citation({"doi": F.lit(None).cast("string")}, {"doi": F.lit("d"), "year": F.lit(1)})
    assert tuple(spark.range(1).select(*merged.values()).first()) == ("d", 1)


def test_cite_keys_past_z(spark):
    notes = [(f"s{k:02}", f"Adams et al. 2017 — {'On 2-D HOMOLOGY of it' if k % 2 else 'One of 3'}", "", "") for k in range(30)]
    got = {r["slug"]: r["cite_key"] for r in C.citations(spark.createDataFrame(notes, "slug string, title string, summary string, body string")).collect()}
    assert [got[f"s{k:02}"][9:] for k in range(30)] == ["", *"abcdefghijklmnopqrstuvwxyz", "Hom", "x", "Hom"]


def test_index_and_config(spark, tmp_path):
    index = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, modificationTime long")
    fresh, gone = C.changed_since(spark.createDataFrame([("a", 2), ("b", 1), ("d", 1)], "path string, modificationTime long"), index)
    assert {r["path"] for r in fresh.collect()} == {"a", "d"} and [r["path"] for r in gone.collect()] == ["c"]
    C.save_vectors(spark.createDataFrame([("a", [1.0])], "slug string, v array<float>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    assert C.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {"QUILLSPARK_A__C": "9"}) == {"a": {"b": 3, "c": "9"}}
    assert set(C.templates()) >= {"base", "procedure"}
