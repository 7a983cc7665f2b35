"""Operators on small fixtures: linking, graphs, queues, logs, articles."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import articles as A
from quillspark.operators import eventlog as E
from quillspark.operators import graph as G
from quillspark.operators import jsondocs as J
from quillspark.operators import linking as L
from quillspark.operators import queues as Q
from quillspark.operators import search as S
from quillspark.operators import stats as ST
from quillspark.operators import timeseries as TS


def tiered(spark, sets, subject=()):
    """Keyword rows of documents 0, 1, ... in given tiers, with the IDF of the whole."""
    n = len(sets)
    rows = [(i, k, "subject" if k in subject else "article") for i, s in enumerate(sets) for k in s]
    kw = spark.createDataFrame(rows, "doc_id long, kw string, tier string")
    freq = L.frequencies(kw, spark.range(n))
    return kw.join(freq, "kw").select("doc_id", "kw", "idf", "tier")


def test_cosine_of_two_with_fillers(spark):
    t = tiered(spark, [["perslay", "a1"], ["perslay", "b1"], ["f1"], ["f2"], ["f3"]])
    found = L.candidates(t).collect()
    assert len(found) == 1 and found[0]["score"] == pytest.approx(0.394, abs=0.005)


def test_evidence_gate(spark):
    assert L.candidates(tiered(spark, [["s1", "s2"], ["s1", "s2"]], subject=("s1", "s2"))).count() == 0
    assert L.candidates(tiered(spark, [["s1", "s2", "s3"], ["s1", "s2", "s3"]], subject=("s1", "s2", "s3"))).count() == 1


def test_merge_rules(spark):
    pairs = lambda *sets, subject=(): {(r["a"], r["b"]): r["ratio"] for r in L.merge_candidates(tiered(spark, sets, subject)).collect()}
    assert pairs(list("abcdef"), list("abcdeg")) == {(0, 1): 0.83}  # 5 of 7 and 5 of 6
    assert pairs(list("abcd"), list("abcd")) == {(0, 1): 1.0}
    assert pairs(list("stuvabcd"), list("stuvefgh"), subject=tuple("stuv")) == {}


def test_count_mode(spark):
    rows = [(i, k) for i, s in enumerate([["1", "2", "3"], ["1", "2", "3", "4"], ["1", "2", "3", "5"]]) for k in s]
    kw = spark.createDataFrame(rows, "doc_id long, kw string")
    assert L.legacy_count(kw, L.frequencies(kw, spark.range(3))).count() == 3
    assert L.legacy_count(kw, L.frequencies(kw, spark.range(3)), least=4).count() == 0


def test_all_subject_corner_keeps_three(spark):
    kw = spark.createDataFrame([(i, k) for i in range(4) for k in "abcde"], "doc_id long, kw string")
    t = L.tiers(kw, L.frequencies(kw, spark.range(4)), floor=2)
    assert t.where("tier = 'article'").groupBy("doc_id").count().where("count = 3").count() == 4


def sequential_rescue(edges, ranked, budgets, floor):
    slug = lambda i: f"doc-{i}"
    degree, edges = {}, set(edges)
    for x, y in edges:
        degree[x], degree[y] = degree.get(x, 0) + 1, degree.get(y, 0) + 1
    linked, added = set(degree), set()
    for a in sorted(budgets, key=slug):
        if a in linked or not ranked.get(a):
            continue
        score, b = ranked[a][0]
        if score < floor or degree.get(b, 0) >= budgets[b]:
            continue
        added.add((min(a, b), max(a, b)))
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    return added


@pytest.mark.parametrize("seed", range(3))
def test_rescue_is_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    n = 40
    pairs = {(a, b): round(r.random(), 3) for a in range(n) for b in range(a + 1, n) if r.random() < 0.12}
    budgets = {i: r.choice([1, 1, 2, 3]) for i in range(n)}
    frame = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, score double")
    rank = L.ranked(frame)
    budget = spark.createDataFrame(list(budgets.items()), "doc_id long, budget int")
    edges = spark.createDataFrame([p for p in pairs if r.random() < 0.05] or [(0, 1)], "a long, b long")
    ranked = {}
    for row in rank.orderBy("doc_id", "rank").collect():
        ranked.setdefault(row["doc_id"], []).append((row["score"], row["other"]))
    want = sequential_rescue([tuple(e) for e in edges.collect()], ranked, budgets, 0.1)
    assert {tuple(x) for x in L.rescued(edges, rank, budget).collect()} == want


def test_mutual_is_symmetric_and_within_budget(spark):
    r = random.Random(5)
    pairs = spark.createDataFrame([(a, b, r.random()) for a in range(15) for b in range(a + 1, 15)], "a long, b long, score double")
    budget = spark.createDataFrame([(i, 3) for i in range(15)], "doc_id long, budget int")
    edges = L.mutual(L.ranked(pairs), budget)
    assert G.undirected(edges, "a", "b").groupBy("src").count().where("count > 3").count() == 0
    assert L.superseded(spark.createDataFrame([(1, 10, 0.9), (1, 2, 0.9)], "a long, b long, ratio double")).collect()[0]["winner"] == "doc-1"


def test_materialised_keeps_typed_links(spark):
    related = "array<struct<slug:string,type:string>>"
    rows = spark.createDataFrame([(1, "doc-1", [("doc-9", "extends"), ("doc-7", "see-also")]), (2, "doc-2", [])], f"doc_id long, slug string, related {related}")
    out = {r["doc_id"]: [(x["slug"], x["type"]) for x in r["related"]] for r in L.materialised(rows, spark.createDataFrame([(1, 2)], "a long, b long")).collect()}
    assert out == {1: [("doc-2", "see-also"), ("doc-9", "extends")], 2: [("doc-1", "see-also")]}


def graph(spark, pairs):
    edges = spark.createDataFrame(pairs, "source string, target string")
    return G.nodes_of(edges), edges


def test_graph_chain(spark):
    nodes, edges = graph(spark, [(str(k), str(k + 1)) for k in range(4)] + [("9", "8")])
    assert G.shortest_path(edges, "0", "4").collect()[0]["length"] == 4
    assert G.shortest_path(edges, "0", "9").count() == 0
    assert G.shortest_path(edges, "2", "2").collect()[0]["path"] == "2"
    assert {r["node_id"] for r in G.neighbors(nodes, edges, "1", "both").collect()} == {"0", "2"}
    assert G.command("shortest path g 0 2", nodes, edges).collect()[0]["path"] == "0 -> 1 -> 2"
    with pytest.raises(ValueError):
        G.command("DROP g", nodes, edges)


def test_graph_parallel_edges_and_active(spark):
    nodes, edges = graph(spark, [("a", "b"), ("a", "b"), ("b", "a")])
    assert G.neighbors(nodes, edges, "a").count() == 2 and G.neighbors(nodes, edges, "a", "both").count() == 1
    assert G.unique_undirected(edges).count() == 1
    live, inside = G.active(nodes.withColumn("lifecycle", F.when(F.col("node_id") == "b", "historical").otherwise("current")), edges)
    assert live.count() == 1 and inside.count() == 0
    assert G.graph_stats(nodes, edges).collect()[0]["edge_count"] == 3


def test_gaps(spark):
    rows = spark.createDataFrame([(1, f"2024-01-01 12:0{m}:00") for m in (0, 1, 2, 5, 6)], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    for found in (TS.gaps(rows, "t", 60.0, ["k"]).collect(), TS.global_gaps(rows, "t", 60.0, "minute").collect()):
        assert [(r["seconds"], r["missing"]) for r in found] == [(180.0, 2)]
    assert TS.time_range(rows, "t", "2024-01-01 12:01:00", "2024-01-01 12:05:00").count() == 3


def test_buckets_keep_unreadable_times(spark):
    rows = spark.createDataFrame([("2024-01-01 10:10:00", 1.0), ("2024-01-01 10:50:00", 3.0), ("x", 5.0)], "t string, v double")
    assert [(str(r["bucket"]), r["n"], r["v_avg"]) for r in TS.buckets(rows, "t").collect()] == [("None", 1, 5.0), ("2024-01-01 10:00:00", 2, 2.0)]
    assert TS.buckets(rows, "t", keep_null=False).count() == 1


def test_json(spark):
    d = spark.createDataFrame([("a", '{"repos":[{"name":"x"},{"name":"y"},{"n":1}],"hello":"world","zero":0,"count":2}')], "slug string, doc string")
    got = lambda p: [r["value"] for r in J.query(d, p).collect()]
    assert got("$.repos[*].name") == ["x", "y"] and got("$.hello") == ["world"] and got("$.zero") == ["0"] and got("$.*") == [] and len(got("$.repos[*]")) == 3
    assert J.doc_stats(d, "slug", "doc").collect()[0]["n_keys"] == 4
    assert d.select(J.list_text(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("v")).first()["v"] == '["a","b"]'
    assert d.select(J.list_from(F.lit("oops")).alias("v")).first()["v"] == []


def test_search_cases(spark):
    body = "slug string, body string, keywords array<string>, type string"
    two = spark.createDataFrame([("python-testing", "python testing with fixtures and python tools", ["python"], "base"), ("rust-concurrency", "rust threads and channels", ["rust"], "process")], body)
    assert [r["slug"] for r in S.search(two, "python testing").collect()] == ["python-testing"]
    assert S.search(two, "the and").count() == 0 and S.search(two, "absent").count() == 0
    three = spark.createDataFrame([("python-basics", "python syntax loops python", [], "base"), ("python-advanced", "python syntax decorators", [], "base"), ("rust-intro", "rust ownership", [], "base")], body)
    assert S.compare(three, "python-basics").collect()[0]["slug"] == "python-advanced"
    assert S.intent("how to learn") == "tutorial" and S.intent("nothing") is None  # `how` is a stop word


def test_rank_fusion(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, rank int")
    two = spark.createDataFrame([("b", 1), ("c", 3), ("d", 2)], "k string, rank int")
    top = S.fused([one, two], "k").collect()[0]
    assert top["k"] == "b" and top["score"] == pytest.approx(1 / 62 + 1 / 61)


def test_hashed_vectors_are_unit(spark):
    v = spark.createDataFrame([("alpha beta gamma",), ("",)], "t string").select(S.hashed_vector(F.col("t"), 16).alias("v")).collect()
    assert sum(x * x for x in v[0]["v"]) == pytest.approx(1, abs=1e-6) and set(v[1]["v"]) == {0.0}


def test_leases(spark):
    ev = [(1, 0, "claim"), (1, 100, "heartbeat"), (2, 0, "claim"), (2, 50, "complete"), (3, 0, "claim"), (3, 10, "fail"), (3, 20, "claim"), (3, 30, "fail"), (3, 40, "claim"), (4, 9000, "claim")]
    states = {r["task_id"]: (r["state"], r["failures"]) for r in Q.lease_states(spark.createDataFrame(ev, "task_id long, at long, kind string"), F.lit(10000)).collect()}
    assert states == {1: ("ready", 1), 2: ("done", 0), 3: ("dead_letter", 3), 4: ("running", 0)}


def test_dispatch_and_effects(spark):
    ready = spark.createDataFrame([(k, k % 2, 1, k) for k in range(8)], "task_id long, assignee long, priority int, created_at long")
    running = spark.createDataFrame([(100, 1)], "task_id long, assignee long")
    assert [r["task_id"] for r in Q.dispatched(ready, running, 2, 3).collect()] == [0, 1, 2]
    log = spark.createDataFrame([("mail", "x")], "kind string, detail string")
    assert Q.not_applied(spark.createDataFrame([("mail", "x"), ("mail", "y"), ("mail", "y")], "kind string, detail string"), log).count() == 1
    assert Q.renamed_statuses(spark.createDataFrame([("pending",), ("qa",)], "status string")).where("status = 'research'").count() == 1
    child = spark.createDataFrame([(7, 1, "run"), (7, 2, "done")], "child_id long, at long, status string")
    states = {r["child_id"]: r["state"] for r in Q.child_states(spark.createDataFrame([(1, 7), (1, 8)], "parent_id long, child_id long"), child).collect()}
    assert states == {7: "done", 8: "timeout"}
    assert Q.over_step_cap(spark.range(25).select(F.lit(1).alias("task_id"), F.col("id").alias("seq"))).count() == 5


def test_event_log(spark):
    lines = spark.createDataFrame([(0, '{"seq":1}'), (1, '{"seq":2}'), (2, '{"se')], "pos long, line string")
    assert [r["seq"] for r in E.readable(lines, "seq int").orderBy("pos").collect()] == [1, 2]
    with pytest.raises(Exception, match="corrupt line 0"):
        E.readable(spark.createDataFrame([(0, "{"), (1, '{"seq":2}')], "pos long, line string"), "seq int").collect()
    gaps = E.sequence_gaps(spark.createDataFrame([(1, 1), (1, 2), (1, 5)], "k long, seq long"), "k").collect()
    assert [(r["before"], r["after"]) for r in gaps] == [(2, 5)]
    ctx = spark.createDataFrame([(1, 1, "context_updated", {"a": "1", "b": "2"}), (1, 2, "context_updated", {"a": "3"})], "pipeline_id long, seq long, type string, context map<string,string>")
    assert {r["key"]: r["value"] for r in E.merged_context(ctx).collect()} == {"a": "3", "b": "2"}


def test_article_changes(spark):
    old = spark.createDataFrame([("a", "A", 1, [], 0), ("b", "B", 1, [], 0)], "slug string, title string, version int, history array<struct<v:int,at:timestamp,by:string,note:string>>, retrieval_count int")
    up = A.updated(old, "a", {"title": F.lit("A2")}, F.lit("2024-01-01"), "me", "why").where("slug = 'a'").first()
    assert (up["title"], up["version"], up["history"][0]["v"]) == ("A2", 2, 2)
    new = spark.createDataFrame([("a", "X"), ("c", "C")], "slug string, title string")
    assert {(r["slug"], r["title"]) for r in A.created(old, new).collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    assert {(r["slug"], r["title"]) for r in A.created(old, new, overwrite=True).collect()} == {("a", "X"), ("b", "B"), ("c", "C")}
    assert A.deleted(old, "a").count() == 1 and A.counted_read(old, "a").where("retrieval_count = 1").count() == 1
    m = A.migrated(old.select("slug")).first()
    assert m["schema_version"] == 3 and m["lifecycle"] == "current" and A.pending(old.select("slug", F.lit(2).alias("schema_version"))).count() == 2


def test_article_checks(spark):
    rows = spark.createDataFrame([("ok-slug", "T", 0.5, True, "q", 0.5), ("Bad Slug", "", 1.5, True, None, None)], "slug string, title string, confidence double, gap boolean, gap_question string, gap_priority double")
    got = {r["slug"]: r["errors"] for r in A.checks(rows).collect()}
    assert got == {"ok-slug": [], "Bad Slug": ["slug", "title", "confidence", "gap"]}
    t = spark.createDataFrame([(["A ", "b"], ["a", "c"])], "keywords array<string>, subject_keywords array<string>")
    assert A.deduped_tiers(t).first()["subject_keywords"] == ["c"]
    assert t.select(A.upgraded_related(F.col("keywords")).alias("r")).first()["r"][0]["type"] == "see-also"


def test_papers(spark):
    rows = spark.createDataFrame([("a", ["k", "x"], [("b", "extends", "")]), ("b", ["k"], []), ("c", ["z"], [])], "slug string, keywords array<string>, paper_comparisons array<struct<other_slug:string,relationship:string,detail:string>>")
    got = lambda x, y: ST.compared(rows, x, y).first()["relationship"]
    assert (got("a", "b"), got("b", "a"), got("a", "c")) == ("extends", "related", "unrelated")
    notes = spark.createDataFrame([("h", "help", "has 39 tools\nand 5 types"), ("x", "base", "3 tools")], "slug string, type string, body string")
    assert [(r["line"], r["found"]) for r in ST.stale_numbers(notes).orderBy("line").collect()] == [(1, "39 tools"), (2, "5 types")]


def test_logs_and_escalations(spark):
    log = spark.createDataFrame([(k, "a" if k % 2 else "b", "x") for k in range(1, 9)], "seq long, source string, kind string")
    assert E.log_rows(log, source="a", since=3).count() == 2 and [r["seq"] for r in E.tail(log, 2).collect()] == [7, 8]
    ev = spark.createDataFrame([(1, 1, "question"), (1, 2, "escalate"), (2, 1, "escalate"), (2, 2, "resume")], "task_id long, seq long, kind string")
    assert {r["task_id"]: (r["paused"], r["questions"]) for r in E.escalations(ev).collect()} == {1: (True, 1), 2: (False, 0)}


def test_task_tables(spark):
    tasks = spark.createDataFrame([(1, "ready", "p1"), (2, "qa", None)], "task_id long, status string, project string")
    links = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "task_id long, article_slug string")
    assert {r["task_id"]: r["articles"] for r in Q.with_article_slugs(tasks, links).collect()} == {1: ["a", "b"], 2: []}
    assert Q.listed(tasks, status="ready", project="p1").count() == 1
    rest = Q.without_task(tasks, links, 1)
    assert rest[0].count() == 1 and rest[1].count() == 0
    titles = Q.with_project_titles(spark.createDataFrame([("p1", 1), ("p2", 1)], "project string, total int"), spark.createDataFrame([("p1", "Mission")], "slug string, title string"))
    assert {r["project"]: r["title"] for r in titles.collect()} == {"p1": "Mission", "p2": "p2"}
    assert len(Q.bounded_rounds(lambda k, last: {"status": "complete" if k == 2 else "continue"})) == 3


def test_article_pages(spark):
    rows = spark.createDataFrame([("a", "Zed", ["x"], "md", "base"), ("b", None, ["needle"], "sql", "note")], "slug string, title string, keywords array<string>, backend string, type string")
    assert [r["slug"] for r in A.table_page(rows).collect()] == ["a", "b"] and [r["slug"] for r in A.table_page(rows, "needle").collect()] == ["b"]
    assert A.table_page(rows, equal={"type": "base"}).count() == 1 and A.by_backend(rows, "sql", "json").count() == 1 and A.type_counts(rows).count() == 2
    texts = rows.withColumn("column_names", F.lit("col1 col2")).withColumn("body", F.lit("text"))
    assert [r[0] for r in texts.select(S.source_text(texts)).collect()] == ["Zed   x text".replace("   ", "  "), "  needle col1 col2"]


def test_claims_cite_notes(spark):
    notes = spark.createDataFrame([("n1", "Adams et al. 2017 — Persistence images", "persistence images vector stable", "research-note"), ("n2", "Other", "persistence images", "base")], "slug string, title string, body string, type string")
    claims = spark.createDataFrame([("c", "Persistence images are stable")], "finding_id string, claim string")
    assert tuple(S.claim_citations(claims, notes).first()) == ("c", "n1", "Adams", 2017)
