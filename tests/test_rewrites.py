"""Rewrites, research runs, point clouds."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import research as R
from quillspark.operators import rewrites as RW
from quillspark.sources import synthetic


def apply(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


def test_vocabulary(spark):
    assert apply(spark, RW.vocabulary, "Furthermore, robust tools showcase it.") == "Also, solid tools show it."
    assert apply(spark, RW.vocabulary, "This is statistically significant.") == "This is statistically significant."
    assert apply(spark, RW.vocabulary, "It is worth noting that cats sleep.") == " cats sleep."


def test_contractions(spark):
    assert apply(spark, RW.contractions, "It is a cat here. We cannot see it. They are all gone.") == "it's a cat here. We can't see it. they're all gone."
    assert apply(spark, RW.contractions, "Only two. Sentences here.") == "Only two. Sentences here."


def test_tone(spark):
    text = "One plain sentence is here. The second sentence is surely long enough to change here. The last one is also quite long and ends here."
    out = apply(spark, RW.tone, text)
    assert "I think the second" in out and "though this may not hold" in out


def test_rhythm(spark):
    text = " ".join(f"w{k}" for k in range(12)) + " and " + " ".join(f"v{k}" for k in range(12)) + ". A b c. D e f. G h i j k l."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "Too short. Really.")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in RW.rhythm(rows).collect()}
    assert out[3] == "Too short. Really." and out[2] is None
    assert "and. V0 v1" in out[1] and "A b c and d e f." in out[1]


def test_rhythm_joins_runs_of_short_sentences_pair_by_pair(spark):
    long = " ".join(f"x{k}" for k in range(30))
    rows = spark.createDataFrame([(1, f"{long}. a b. C d. E f. {long}. G h. I j. K l.")], "doc_id long, text string")
    assert RW.rhythm(rows).first()["text"] == f"{long}. a b and c d. E f. {long}. G h and i j. K l."


def test_sweep_scores(spark):
    text = "Moreover, the tools of the model are good and robust in their way. It is a cat. " * 4
    phrases = spark.createDataFrame([("robust", "word", "~40x")], "word string, category string, ratio string")
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, ""), (5, "One word. Two. Three.")], "doc_id long, text string")
    every = {(r["doc_id"], r["stage"]): r for r in RW.sweep_scores(docs, phrases).collect()}
    assert set(every) == {(d, s) for d in range(1, 6) for s in ("before", *RW.SWEEPS)}
    found = {s: r for (d, s), r in every.items() if d == 1}
    assert found["before"]["fingerprints"] == 1 and found["vocabulary"]["fingerprints"] == 0 and found["vocabulary"]["fingerprints_change"] == -1
    assert all(0 <= r["human_pct"] <= 100 for r in every.values()) and found["before"]["human_pct_change"] == 0
    assert {s: (r["words"], r["fingerprints"], r["human_pct"]) for (d, s), r in every.items() if d in (3, 4)} == dict.fromkeys(found, (0, 0, 0))
    assert {r["words"] for (d, _), r in every.items() if d == 2} == {1} and {r["fingerprints_change"] for (d, _), r in every.items() if d > 1} == {0}


def test_research_run(spark):
    articles = spark.createDataFrame([("graphs", "graph theory nodes edges graph"), ("birds", "birds fly south")], "slug string, body string")

    def search_fn(query):
        return spark.createDataFrame([("f1", "However graph nodes edges differ", "T", "u")], "finding_id string, snippet string, title string, url string")

    out = R.run("What are graphs", articles, search_fn)
    assert out["status"] == "completed" and out["findings"].where("slug = 'graphs' AND relationship = 'contradicts'").count() == 5
    assert out["report"].first()["report"].startswith("# What are graphs")
    assert R.run("q", articles, search_fn, review=lambda _: False)["status"] == "paused"
    assert R.run("q", articles, lambda q: search_fn(q).where("false"))["problems"] == ["no findings"]


def test_point_clouds(spark):
    r = synthetic.sphere(spark, 50, 2.0).select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r")).collect()
    assert all(x["r"] == pytest.approx(2.0) for x in r)
    t = synthetic.torus(spark, 50).select(((F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) - 2.0) ** 2 + F.col("z") ** 2).alias("d")).collect()
    assert all(x["d"] == pytest.approx(0.25) for x in t)
