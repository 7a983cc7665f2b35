"""What reviews found: cases that once gave other rows than the SQL, and plans that grew faster than their input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import articles as A
from quillspark.operators import linking as L
from quillspark.operators import research as R
from quillspark.operators import rewrites as RW
from quillspark.operators import search as S
from quillspark.operators import textindex as X
from quillspark.operators import vectorindex as V
from quillspark.plans import catalog, stream_queries
from quillspark.streaming import folds
from quillspark.streaming import stateful as SF


def test_slug_keeps_dashes_before_a_last_line_feed(spark):
    rows = spark.createDataFrame([("Of the\nday -\n",), ("the day -",)], "q string")
    assert [r["s"] for r in rows.select(text.slug_from_question(F.col("q")).alias("s")).collect()] == ["of-the\nday-\n", "the-day"]


def test_tasks_with_one_slug_keep_their_own_article(spark, tmp_path):
    a, b = 25302, 82945  # one title, and one beginning of the hash
    spark.createDataFrame([(2, "blue bolt"), (a, "blue bolt"), (b, "blue bolt")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    rows = catalog.queries()["task_procedures"](spark, str(tmp_path)).collect()
    assert sorted(r["task_id"] for r in rows) == [2, a, b] and len({r["slug"] for r in rows}) == 2


def test_pages_of_one_address_are_files_of_their_own(spark, tmp_path):
    spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["path"] for r in catalog.queries()["unqueued_files"](spark, str(tmp_path)).collect()) == ["a", "b"]


def test_postings_hold_a_bounded_number_of_counts():
    texts = [" ".join(f"w{i}x{k}" for k in range(1000)) for i in range(120)]
    held = [b.num_rows for b in A.counted([pa.RecordBatch.from_pydict({"doc_id": list(range(120)), "text": texts})], "doc_id")]
    assert sum(held) == 120_000 and max(held) < A.HELD + 1000


def test_tone_splits_a_text_once(spark):
    text = "The second sentence is surely long enough to change here. " * 20_000  # split once for each sentence, this takes hours
    out = spark.createDataFrame([(text,)], "t string").select(RW.tone(F.col("t")).alias("v")).first()["v"]
    assert out.count("I think the second") == 1 and out.count("though this may not hold") == 1 and out.count("Still, the") == 1


def test_vocabulary_is_worked_out_once(spark, capsys):
    spark.createDataFrame([("x",)], "t string").select(RW.vocabulary(F.col("t")).alias("v")).explain()
    assert capsys.readouterr().out.count("regexp_replace(") < 20
    words = "In the landscape of conclusion, a Notably Crucial thing."
    assert spark.createDataFrame([(words,)], "t string").select(RW.vocabulary(F.col("t")).alias("v")).first()["v"] == "Finally, a Key thing."


def test_scores_of_rewrites_join_nothing_by_key(spark, capsys):
    docs = spark.createDataFrame([(1, "It is so. ")], "doc_id long, text string")
    RW.sweep_scores(docs, spark.createDataFrame([("a", "b", "~1x")], "word string, category string, ratio string")).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and plan.count("Generate explode") == 1


def test_nearest_articles_take_rows_by_text_and_not_by_pair(spark, capsys):
    sets = [("f1", "a b c d e f g h"), ("f2", "a b x y"), ("f3", "q"), ("f4", "a b")]
    words = spark.createDataFrame([(n, w) for n, s in sets for w in s.split()], "path string, kw string")
    articles = {"one": "a b c d e z", "two": "a", "wide": " ".join(f"k{i}" for i in range(20)) + " x y a b"}
    known = spark.createDataFrame([(n, w, len(s.split())) for n, s in articles.items() for w in s.split()], "slug string, kw string, _size int")
    found = {r["path"]: (r["_ratio"], r["_shared"]) for r in R.nearest(words, known, "path").collect()}
    assert found == {"f1": (1.0, 1), "f2": (1.0, 4), "f4": (1.0, 2)}
    many = spark.range(1000).select(F.col("id").cast("string").alias("path"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("kw"))
    R.nearest(many, many.select(F.col("path").alias("slug"), "kw", F.lit(2).alias("_size")), "path").explain()
    assert "slug" not in capsys.readouterr().out.split("Join")[1]  # no row of a file and an article


def test_merges_over_several_blocks_equal_all_pairs(spark, capsys):
    sets = [{"common", f"a{i % 7}", *(f"r{i // 2}x{k}" for k in range(2 + i % 2 + 6 * (i % 3 > 0)))} for i in range(600)]
    kw = spark.createDataFrame([(i, k) for i, s in enumerate(sets) for k in s], "doc_id long, kw string")
    tier = L.tiers(kw, L.frequencies(kw, spark.range(600)))
    article = {}
    for r in tier.where("tier = 'article'").collect():
        article.setdefault(r["doc_id"], set()).add(r["kw"])

    def merges(a, b):
        x, y = article.get(a, set()), article.get(b, set())
        return len(x & y) >= 0.7 * max(len(x | y), 1) or len(sets[a] & sets[b]) > 0.8 * min(len(sets[a]), len(sets[b]))

    found = L.merge_candidates(tier)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [(a, b) for a in range(600) for b in range(a + 1, 600) if merges(a, b)]
    found.explain()
    assert "_marked" in capsys.readouterr().out  # a keyword that nobody asks by is not dealt out


def test_best_candidates_by_blocks_equal_the_ranking_of_all(spark, monkeypatch):
    sets = [{"c0", "c1", f"c{2 + i % 3}", f"a{i % 7}", f"b{i % 40}", *(f"r{i // 3}x{k}" for k in range(i % 4))} for i in range(500)]
    kw = spark.createDataFrame([(i, k) for i, s in enumerate(sets) for k in s], "doc_id long, kw string")
    tier = L.tiers(kw, L.frequencies(kw, spark.range(500)))
    budget = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 5 + 1).cast("int").alias("budget"))
    want = {tuple(r) for r in L.ranked(L.candidates(tier)).join(budget, "doc_id").where("rank <= budget").select("doc_id", "other", "score", "rank").collect()}
    for held, asking, tail in ((100, 60, 0.3), (1000, 1000, 0.9)):
        monkeypatch.setattr(L, "HELD", held), monkeypatch.setattr(L, "ASKING", asking), monkeypatch.setattr(L, "TAIL", tail)
        assert {tuple(r) for r in L.best(tier, budget).collect()} == want
    assert len({d for d, *_ in want}) == 500
    bounded = L.best(tier, budget, threshold=0.0).where("rank > 0")
    assert bounded.groupBy("doc_id").count().join(budget, "doc_id").where("count > budget").count() == 0


def test_mutual_links_rank_no_list_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "candidates", None)
    assert catalog.queries()["link_mutual_topk"](spark, "/root/testdata/sf0.001").count() > 0


def test_products_held_by_a_task_are_bounded(spark, tmp_path, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000))})
    assert max(p.num_rows for p in V.pieces(batch, 16_384)) * 16_384 <= V.CELLS and sum(p.num_rows for p in V.pieces(batch, 16_384)) == 10_000
    rows = spark.range(300).select("id", F.array(*[F.rand(k).cast("float") for k in range(4)]).alias("vector")).cache()
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    found = []
    for cells in (1_000_000, 40):
        monkeypatch.setattr(V, "CELLS", cells)
        index = V.VectorIndex(spark, f"{tmp_path}/{cells}")
        index.build(rows, lists=9)
        found.append(sorted(map(tuple, index.search(asked, exact=True).collect())))
    assert found[0] == found[1] and len(found[0]) == 300


def test_hashed_vectors_read_tokens_once(spark, capsys):
    rows = spark.createDataFrame([("alpha beta beta",), ("",), (None,)], "t string")
    rows.select(S.hashed_vector(F.col("t")).alias("v")).explain()
    assert capsys.readouterr().out.count("filter(") <= 3
    one, none, null = (r["v"] for r in rows.select(S.hashed_vector(F.col("t"), 16).alias("v")).collect())
    assert sorted(round(abs(x), 4) for x in one)[-2:] == [0.4472, 0.8944] and none == [0.0] * 16 and null == [None] * 16


def test_gaps_set_one_timer_a_batch(monkeypatch):
    timers, state = [], []
    handle = type("H", (), {"registerTimer": lambda self, t: timers.append(t)})()
    gaps = SF.Gaps(1.0)
    gaps.handle, gaps.waiting = handle, type("L", (), {"appendList": lambda self, x: state.extend(x)})()
    list(gaps.handleInputRows((1,), iter([pd.DataFrame({"at": [5000, 1000, 9000]})]), None))
    assert timers == [1] and len(state) == 3


def test_batches_do_not_grow_with_files(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("event_id"), F.current_timestamp().alias("ts"))
    rows.repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    folds.written(stream_queries.source(spark, str(tmp_path)), lambda df, k: None, "append", f"{tmp_path}/out")
    assert len([f for f in (tmp_path / "out" / "offsets" / "commits").iterdir() if f.name.isdigit()]) <= stream_queries.BATCHES


def test_best_matches_in_tasks_equal_the_join(spark, monkeypatch):
    articles = spark.createDataFrame([(f"doc-{i}", f"alpha{i % 5} beta{i % 3} the gamma{i % 7} gamma{i % 7}" if i else None) for i in range(40)], "slug string, body string").repartition(3)
    findings = spark.createDataFrame([(i, f"gamma{i} beta1 the alpha2 alpha2") for i in range(9)] + [(9, None), (10, "unheard")], "finding_id long, claim string")
    one = sorted(map(tuple, S.best_matches(findings, articles).collect()))
    monkeypatch.setattr(S, "_best_of_tasks", None)
    monkeypatch.setattr(S, "ASKED", 3)
    names = ("finding_id", "slug", "score")
    assert one == sorted(tuple(r[n] for n in names) for r in S.best_matches(findings, articles).select(*names).collect()) and len(one) == 9


def test_links_by_blocks_of_postings_equal_all_pairs(spark, monkeypatch):
    sets = [{"c0", f"c{1 + i % 3}", f"a{i % 7}", f"b{i % 40}", *(f"r{i // 3}x{k}" for k in range(i % 4))} for i in range(300)]
    kw = spark.createDataFrame([(i, k) for i, s in enumerate(sets) for k in s], "doc_id long, kw string")
    freq = L.frequencies(kw, spark.range(300))
    tier = L.tiers(kw, freq)
    of = {(r["doc_id"], r["kw"]): (r["idf"] * L.TIER_WEIGHTS[r["tier"]], r["tier"], r["idf"]) for r in tier.collect()}
    plain = {r["kw"] for r in L.bridges(kw, freq).select("kw").distinct().collect()}
    norm = [sum(of[i, k][0] ** 2 for k in s) ** 0.5 for i, s in enumerate(sets)]
    want = [set(), set(), set()]
    for a in range(300):
        for b in range(a + 1, 300):
            both = sets[a] & sets[b]
            kinds = [{of[a, k][1], of[b, k][1]} for k in both]
            score = round(sum(of[a, k][0] * of[b, k][0] for k in both) / (norm[a] * norm[b]), 9)
            if ({"article"} in kinds or kinds.count({"subject"}) >= 3) and score >= 0.1:
                want[0].add((a, b, round(score, 7)))
            idf = round(sum(of[a, k][2] for k in both & plain), 9)
            if idf >= 5.5:
                want[1].add((a, b, round(idf, 7)))
            if len(both & plain) >= 2:
                want[2].add((a, b, len(both & plain)))
    monkeypatch.setattr(L, "compared_pairs", None)  # no pairs of blocks of a keyword
    for held, asking, given, sparse in ((100, 60, 500, 0), (1000, 1000, 200_000, 10**6)):
        for name, value in (("HELD", held), ("ASKING", asking), ("GIVEN", given), ("SPARSE", sparse)):
            monkeypatch.setattr(L, name, value)
        found = [L.candidates(tier), L.legacy_idf(kw, freq), L.legacy_count(kw, freq)]
        found = [[(r[0], r[1], round(r[2], 7)) for r in f.collect()] for f in found]
        assert [set(f) for f in found] == want and [len(f) for f in found] == [len(w) for w in want]
    assert all(want)


def test_index_shuffles_no_terms_of_rows(spark, tmp_path, monkeypatch):
    schema = "slug string, body string, lifecycle string, doc_type string"
    old = [(f"a{i}", f"alpha{i % 3} beta{i % 2} beta{i % 2} gamma", "current", "how-to") for i in range(12)]
    new = [(f"a{i}", f"beta0 alpha{i % 2} delta", "historical", None) for i in range(5)]
    live = spark.createDataFrame([*new, *old[5:10]], schema)
    monkeypatch.setattr(X, "LISTED", 5)
    for sent in (500_000, 0):
        monkeypatch.setattr(X, "SENT", sent)
        index = X.TextIndex(spark, f"{tmp_path}/{sent}", buckets=3)
        index.upsert(spark.createDataFrame(old, schema))
        index.upsert(spark.createDataFrame(new, schema), spark.createDataFrame([("a10",), ("a11",)], "slug string"))
        auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where marks are many
        plan = index.live_rows()._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        assert ("SortMergeJoin" in plan) == (sent == 0)
        assert set(index.table("postings").columns) == {"term", "nr", "tf", "segment", "bucket"}
        for merged in (False, True):
            if merged:
                index.merge()
            assert [tuple(r) for r in index.search("beta0 alpha1").collect()] == [tuple(r) for r in S.search(live, "beta0 alpha1").collect()]
            assert sorted(tuple(r) for r in index.holding("beta1").collect()) == [("a5", 2), ("a7", 2), ("a9", 2)]


def test_compare_weighs_articles_in_their_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    bodies = [" ".join([*rng.choices(words, range(12, 0, -1), k=rng.randint(2, 9)), *(f"rare{rng.randint(0, 40)}" for _ in range(rng.randint(0, 3))), "x the"]) for _ in range(40)]
    bodies += [bodies[0], bodies[0].upper(), "W1 K9 é7w2", "", None, "the a x", "only here"]
    rows = {f"a{i}": b for i, b in enumerate(bodies)}
    counts = {s: Counter(t for t in re.findall("[a-z0-9]{2,}", (b or "").lower()) if t not in text.STOP_WORDS) for s, b in rows.items()}
    idf = {t: math.log((len(rows) + 1) / (sum(t in c for c in counts.values()) + 1)) + 1 for t in set().union(*counts.values())}
    w = {s: {t: n / max(c.values()) * idf[t] for t, n in c.items()} for s, c in counts.items()}
    norm = {s: math.sqrt(sum(x * x for x in v.values())) for s, v in w.items()}
    want = {s: round(sum(x * w["a0"].get(t, 0) for t, x in v.items()) / (norm[s] * norm["a0"]), 9) for s, v in w.items() if s != "a0" and v}
    want = sorted(((-x, s) for s, x in want.items() if x > 0))
    articles = spark.createDataFrame(list(rows.items()), "slug string, body string").repartition(3)
    seen, postings = [], S.postings
    monkeypatch.setattr(S, "postings", lambda docs, *a: seen.append(docs.count()) or postings(docs, *a))
    for weighed, asked in ((200_000, 200_000), (8, 200_000), (1, 0), (0, 200_000)):
        monkeypatch.setattr(S, "WEIGHED", weighed)
        monkeypatch.setattr(S, "ASKED", asked)
        seen.clear()
        for k in (3, 60):
            assert [(r["slug"], r["score"]) for r in S.compare(articles, "a0", k).collect()] == [(s, round(-x, 4)) for x, s in want[:k]]
        assert seen == [1, 1] or weighed < 200_000  # postings of the one article only
        assert seen[1] < 20 or weighed == 200_000  # and of those that the bounds leave open
    assert S.compare(articles, "a43").count() == S.compare(articles, "absent").count() == 0
    got = {(r["key"], r["term"], r["tf"]) for r in A.postings(articles, "slug", "body").withColumnRenamed("slug", "key").collect()}
    assert got == {(s, t, n) for s, c in counts.items() for t, n in c.items()}


def test_a_group_gives_the_best_of_all_its_lists(monkeypatch):
    monkeypatch.setattr(V, "PART", 30)
    assert V.packed([10, 20, 1, 65, 0, 29, 2]).tolist() == [[0, 1], [0, 1], [1, 1], [2, 3], [5, 1], [5, 1], [6, 1]]
    rng = np.random.default_rng(2)
    q, v = np.round(rng.normal(size=(4, 3)), 1), np.round(rng.normal(size=(60, 3)), 1).astype(np.float32)
    v[40:] = v[:20]  # equal scores go by id
    read = [[0, 1, 2, 3, 4, 5], [1, 3], [], [0, 5]]
    scores = np.round(q @ v.astype(np.float64).T, V.PLACES)
    all_of = [sorted((-scores[i, j], j) for j in range(60) if j // 10 in lists) for i, lists in enumerate(read)]
    for least in (None, 7):  # the second: what the first pass has found
        for cells in (1_000_000, 8):
            monkeypatch.setattr(V, "CELLS", cells)
            bounds = [None if least is None or not x else -x[min(least, len(x) - 1)][0] for x in all_of]
            best = V.Best(5)
            best.ask(pa.array(range(4)), pa.array(q.tolist()), pa.array(bounds, pa.float64()), pa.array(read, pa.list_(pa.int32())))
            for b in range(6):
                ids = range(b * 10, b * 10 + 10)
                best.meet(b, pa.RecordBatch.from_arrays([pa.nulls(10)] * 3 + [pa.array(ids), pa.array(v[b * 10 : b * 10 + 10].tolist(), pa.list_(pa.float32()))], list("abcde")))
            got = [(r["qid"], -r["score"], r["id"]) for x in best.given() for r in x.to_pylist()]
            assert got == [(i, *x) for i in range(4) for x in all_of[i][:5] if bounds[i] is None or -x[0] >= bounds[i]]  # five for a question, not for each of its lists


def test_keywords_shuffle_what_can_be_among_the_best(spark, monkeypatch):
    texts = [" ".join([f"c{i % 3}"] * 3 + [f"m{i % 20}x{k}" for k in range(12)] + [f"r{i // 2}x{k} " * (k % 2 + 1) for k in range(i % 13)] + [f"one{i}"]) for i in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (120, ""), (121, None)], "doc_id long, text string").repartition(3)
    counts = {i: A.term_counts(t) for i, t in enumerate(texts)}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log(123 / (n + 1)) + 1 for t, n in df.items() if 2 <= n <= 0.2 * 122}
    best = {i: sorted((t for t in c if t in idf), key=lambda t: (-round(c[t] / max(c.values()) * idf[t], 9), t))[:10] for i, c in counts.items()}
    for held in (200_000, 40, 1):
        monkeypatch.setattr(A, "WEIGHED", held)
        assert sorted(map(tuple, A.keywords(docs).collect())) == sorted((i, t) for i, ts in best.items() for t in ts)
    few = A.strongest(docs, {f"r{j}x{k}": 4.0 for j in range(60) for k in range(13)} | {f"m{j}x{k}": 3.0 for j in range(20) for k in range(12)}, -1.0, 2)
    assert 0 < few.count() < sum(map(len, counts.values())) / 2 and few.where("term LIKE 'one%'").count() == 0


def test_linked_documents_are_sent_as_codes(spark):
    rows = spark.createDataFrame([(1, "b", 2.0, True), (1, "a", 2.0, False), (1, "z", 1.0, True), (2, "z", 1.0, False), (2, "q", 3.0, False)], "doc_id long, kw string, idf double, article boolean")
    sent, steps, alone = L.coded(rows)
    assert {r["doc_id"]: r["codes"] for r in sent.collect()} == {1: [2, 5, 7], 2: [0, 6]}  # q, a, b, z
    assert sent.dtypes[1] == ("codes", "array<int>") and (steps, alone) == ([(0, 3.0), (1, 2.0), (3, 1.0)], 3)
    u, w, e = L.Weights(steps, L.by_tier)(np.array([0, 5, 7]))
    assert np.allclose(w, [1.8, 2.8, 1.4]) and list(e) == [1, L.MANY, L.MANY]


def test_losers_of_merges_are_reduced_before_they_are_sorted(spark, capsys):
    merges = spark.createDataFrame([(-10, 2, 1.0), (-10, 1, 1.0), (-20, -10, 1.0), (3, 12, 1.0), (5, 12, 1.0), (4, 12, 1.0), (3, 5, 1.0)], "a long, b long, ratio double")
    out = L.superseded(merges)
    assert {tuple(r) for r in out.collect()} == {("doc--10", "doc-2"), ("doc-12", "doc-5"), ("doc-5", "doc-3")}
    out.explain()
    assert "Sort" not in capsys.readouterr().out


def test_merges_send_a_document_as_often_as_there_are_tiles(spark, monkeypatch):
    sets = [["c0", "c1", "c2", "c3", f"a{i % 9}", f"r{i // 2}"] for i in range(3000)]
    kw = spark.createDataFrame([(i, k) for i, s in enumerate(sets) for k in s], "doc_id long, kw string")
    tier, sent, dealt = L.tiers(kw, L.frequencies(kw, spark.range(3000))), [], L.dealt_tiles
    monkeypatch.setattr(L, "dealt_tiles", lambda *a: sent.append(dealt(*a)) or sent[-1])
    assert {(r["a"], r["b"]) for r in L.merge_candidates(tier).collect()} >= {(i, i + 1) for i in range(0, 3000, 2)}
    assert sent[0].count() <= 3 * 3000


def test_index_sends_row_numbers_not_slugs(spark, tmp_path, monkeypatch):
    rows = lambda n, word: spark.range(n).select(F.concat(F.lit("s"), "id").alias("slug"), F.concat(F.lit(f"{word} w"), F.col("id") % 7).alias("body"))
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append((df.columns, df.count())) or broadcast(df))
    index = X.TextIndex(spark, f"{tmp_path}/i", buckets=2)
    index.upsert(rows(1000, "old"))
    index.upsert(rows(600, "new"), rows(700, "x").where("slug > 's690'").select("slug"))
    index.merge()
    gone = {f"s{i}" for i in range(600, 700) if f"s{i}" > "s690"}
    assert {r["slug"] for r in index.live_rows().collect()} == {f"s{i}" for i in range(1000)} - gone
    df = {r["term"]: r["df"] for r in index.frequencies().collect()}
    assert df["new"] == 600 and df["old"] == 400 - len(gone) == index.live() - 600
    assert sent and all("slug" not in names and n <= 1000 / 16 for names, n in sent)


def test_scores_of_a_text_in_one_pass_equal_the_three_queries(spark):
    from quillspark.operators import stats as ST

    texts = ["", None, "One word.", " a b c  d e. F g h\x1c i! It's THE İstanbul modelK? \n\n we don't Care; data data robust robust_tool", "Robust  tools of the system are good. They were it. No. We can not see what it is!  Data, data and data of theirs. ", "x. " * 50, "été naïve ΣΣ 'tis\tours.\x0bA b c d. E f g h i"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    phrases = spark.createDataFrame([("robust", "word", "~40x"), ("robust_tools", "word", "~2x"), ("of the", "formulaic_phrase", "x"), ("", "word", "~1x")], "word string, category string, ratio string")
    found = ST.measured(docs.select(F.col("doc_id").alias("_k"), "text"), [r["word"] for r in phrases.collect()])
    found = found.select("*", *ST.category_shares(), *[c for c in ST.variance_columns() if str(c) != str(F.col("sentences"))])
    names = [n for n in (*ST.CATEGORIES, "total", "noun_pronoun_ratio", "functional_ratio", "sentences", "total_words", "unique_words", "sentence_mean", "sentence_std", "sentence_cv", "ttr", "hapax_ratio", "avg_word_len", "repetition_ratio")]
    want = ST.category_ratios(docs).join(ST.text_variance(docs, every=True), "doc_id").join(ST.phrase_scan(docs, phrases).select("doc_id", F.col("matches").alias("fingerprints")), "doc_id")
    row = lambda r, k: (r[k], *(r[n] for n in (*names, "fingerprints")))
    assert sorted(row(r, "_k") for r in found.collect()) == sorted(row(r, "doc_id") for r in want.collect())
    one = {(r["doc_id"], r["stage"]): r for r in RW.sweep_scores(docs, phrases).collect()}
    assert len(one) == 5 * len(texts)


def test_blocks_are_sent_to_no_more_parts_than_keep_the_cores_at_work(spark, monkeypatch):
    monkeypatch.setattr(L, "ASKING", 1)
    sent = L.dealt_tiles(spark.range(200).select(F.col("id").alias("doc_id")))
    assert sent.count() <= 200 * (1 + max(32, 2 * spark.sparkContext.defaultParallelism))
