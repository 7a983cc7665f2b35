"""The vector index against all products, with changes, and its pruned reads."""

import numpy as np
import pytest

from quillspark.operators import vectorindex as V


def brute(vectors, questions, k):
    out = {}
    for qid, q in questions:
        scored = sorted((-round(float(np.dot(np.float64(q), np.float64(np.float32(v)))), V.PLACES), i) for i, v in vectors.items())[:k]
        out[qid] = [(i, -s) for s, i in scored]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize(("part", "block"), [(20_000, 2_000), (7, 3)])
def test_exact_answers_equal_all_products(spark, tmp_path, part, block, monkeypatch):
    monkeypatch.setattr(V, "PART", part)
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = {i: [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=8) * 0.3)] for i in range(200)}
    vectors |= {1000 + i: vectors[0] for i in range(40)}  # copies: equal scores go by id
    schema = "id long, vector array<float>"
    index = V.VectorIndex(spark, str(tmp_path / "ix"))
    index.build(spark.createDataFrame(list(vectors.items()), schema), lists=9)
    assert index.live() == 240
    new = {i: [float(x) for x in np.float32(rng.normal(size=8))] for i in (3, 5, 500, 501)}
    index.upsert(spark.createDataFrame(list(new.items()), schema), spark.createDataFrame([(7,), (8,), (9999,)], "id long"))
    vectors = {i: v for i, v in (vectors | new).items() if i not in (7, 8)}
    assert index.live() == len(vectors)
    questions = [(q, [float(x) for x in rng.normal(size=8)]) for q in range(7)] + [(7, vectors[0])]
    asked = spark.createDataFrame(questions, "qid long, q array<double>")
    want = brute(vectors, questions, 5)
    exact = index.search(asked, k=5, probes=2, exact=True)
    assert answers(exact) == want
    some = index.search(asked, k=5, probes=4)
    share = sum(len(set(a) & set(dict(want)[q])) for q, a in answers(some).items()) / 40
    row = V.recall(some, exact).first()
    assert row["questions"] == 8 and row["recall"] == pytest.approx(share, abs=1e-4) and share > 0.6
    assert 1 <= index.probes(0.5, k=5, sample=20) <= index.probes(1.0, k=5, sample=20) <= 9
    assert answers(index.search(asked.where("qid = 7"), k=500, probes=1, exact=True)) == brute(vectors, questions[7:], 500)


def test_only_the_lists_asked_for_are_read(spark, tmp_path):
    vectors = [(i, [float(i // 10 == d) for d in range(4)]) for i in range(40)]
    index = V.VectorIndex(spark, str(tmp_path / "ix"))
    index.build(spark.createDataFrame(vectors, "id long, vector array<float>"), lists=4)
    found = index.search(spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0])], "qid long, q array<double>"), k=3, probes=1, exact=True)
    assert [(r["id"], r["score"]) for r in sorted(found.collect(), key=lambda r: r["rank"])] == [(10, 1.0), (11, 1.0), (12, 1.0)]
    shown = index.table("vectors").where("bucket = 1")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in shown.split("PartitionFilters")[1].split("PushedFilters")[0]
