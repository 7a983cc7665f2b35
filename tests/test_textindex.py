"""The persisted index against searches of the articles themselves, over changes, removals, merges and broken-off writes."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search as S
from quillspark.operators.textindex import TextIndex

WORDS = [f"w{k}" for k in range(40)] + ["guide", "the"]
SCHEMA = "slug string, body string, lifecycle string, doc_type string"


def some(rng, slugs):
    return [(s, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))), rng.choice(["current", "historical", "superseded", None]), rng.choice(["how-to", "reference", None])) for s in slugs]


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_follows_changes(spark, tmp_path):
    rng = random.Random(2)
    index, state = TextIndex(spark, str(tmp_path / "ix"), buckets=5), {}
    assert rows(index.search("w1 w2")) == [] and index.live() == 0
    for step in range(4):
        changed = some(rng, rng.sample([f"a{k}" for k in range(40)], 12))
        gone = rng.sample([f"a{k}" for k in range(40)], 4 if step else 0)
        gone = [g for g in gone if g not in {c[0] for c in changed}] + ["never there"]
        index.upsert(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(g,) for g in gone], "slug string"))
        state = {k: v for k, v in (state | {c[0]: c for c in changed}).items() if k not in gone}
        if step == 2:
            index.merge([1, 2])
        if step == 3:
            index.merge()
            index.vacuum()
        articles = spark.createDataFrame(list(state.values()), SCHEMA)
        for query in ("w1 w2 w2 w3", "guide w7"):
            assert rows(index.search(query)) == rows(S.search(articles, query)), (step, query)
        assert rows(index.search("w1 w2", where=F.col("doc_type") == "how-to")) == rows(S.search(articles, "w1 w2", where=F.col("doc_type") == "how-to"))
        assert index.live() == len(state)
        held = {w: sum(w in v[1].split() for v in state.values()) for w in WORDS if w != "the"}
        assert {r["term"]: r["df"] for r in index.frequencies().collect()} == {w: n for w, n in held.items() if n}
        assert sorted(rows(index.holding("w5"))) == sorted((k, v[1].split().count("w5")) for k, v in state.items() if "w5" in v[1].split())
    assert TextIndex(spark, str(tmp_path / "ix")).buckets == 5


def test_a_write_that_stopped_counts_for_nothing(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=3)
    index.upsert(spark.createDataFrame([("a", "one two", None, None), ("b", "two", None, None)], SCHEMA))
    before = rows(index.search("one two"))
    for name in ("_write_postings", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(TextIndex, name, lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(RuntimeError):
                index.upsert(spark.createDataFrame([("a", "three", None, None)], SCHEMA), spark.createDataFrame([("b",)], "slug string"))
        assert rows(index.search("one two")) == before and index.live() == 2
    assert index.upsert(spark.createDataFrame([("a", "three", None, None)], SCHEMA)) == 2
    assert [r[0] for r in rows(index.search("one two three"))] == ["a", "b"] and index.live() == 2


def test_only_the_buckets_asked_for_are_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=16)
    index.upsert(spark.createDataFrame([(f"a{k}", f"w{k} w{k + 1}", None, None) for k in range(50)], SCHEMA))
    shown = plan(index.asked("postings", ["w7"]))
    assert "PartitionFilters" in shown and "bucket" in shown.split("PartitionFilters")[1].split("PushedFilters")[0] and "term,w7" in shown.split("PushedFilters")[1].replace(" ", "")
    read = {r["f"] for r in index.asked("postings", ["w7"]).select(F.input_file_name().alias("f")).collect()}
    assert len(read) == 1 and "segment=1/bucket=" in read.pop()


def test_removed_only_and_empty(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=2)
    index.upsert(spark.createDataFrame([("a", "one", None, None), ("n", None, None, None), ("e", "", None, None)], SCHEMA))
    assert index.live() == 3
    index.upsert(removed=spark.createDataFrame([("a",), ("a",)], "slug string"))
    assert rows(index.search("one")) == [] and index.live() == 2 and rows(index.frequencies()) == []
    index.merge()
    index.upsert(spark.createDataFrame([("a", "one one", None, None)], SCHEMA))
    assert [r[0] for r in rows(index.search("one"))] == ["a"]
