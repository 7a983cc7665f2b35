"""Ranked search and the divergence audit against SQL and plain loops, with small windows, blocks and chunks, and on odd input."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillspark.llm import divergence, ranking

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, rank string, score string, term string, item_id string, block string, n string, value string"
PAD = ("x",) * 7


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 977} x" for k in range(60_000))
    found = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n!?", None, "b"), (4, "One two THREE", "en", "a"), (5, "one two three", "en", "b"), (5, "one two three", "en", "b"), (7, long, "en", "c"),
        (8, "one", None, None), (None, "one two", "fr", "b"), (10, "été É two", "fr", None), (11, "x9y one_two", "en", "c"), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, *PAD) for r in found], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, most=10):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c in docs:
            m = 10 + (90 * c.total() * n) // total
            v = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            found += [(-v, d is None, d, v)] if v > 0 else []
        out += [(i, k + 1, d, v) for k, (_, _, d, v) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "block", "buckets"), [(4096, 1 << 19, 64), (7, 100, 2)])
def test_ranks_equal_sql(spark, docs, duck, window, block, buckets, monkeypatch):
    for name, v in (("WINDOW", window), ("BLOCK", block), ("BUCKETS", buckets)):
        monkeypatch.setattr(ranking, name, v)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert rows(ranking.rank(docs.repartition(5), items)) == sorted(duck.execute(ranking.ORACLE).fetchall(), key=repr)


@pytest.mark.parametrize("window", [1, 3, 4096])
def test_ranks_of_odd_rows(spark, odd, none, window, monkeypatch):
    monkeypatch.setattr(ranking, "WINDOW", window)
    items = [(0, "one two"), (1, None), (2, "ÉTÉ été x9y"), (None, "three"), (4, "!!"), (0, "w5"), (5, "nowhere")]
    table = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, doc_id string, rank string")
    want = brute_ranks([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    assert len([x for x in want if x[0] == 0 and x[2] == 5]) == 2  # rows that repeat a doc_id
    for most in (1, 10):
        assert rows(ranking.rank(odd.repartition(3), table, most)) == brute_ranks([(r["doc_id"], r["text"]) for r in odd.collect()], items, most)
    assert rows(ranking.rank(none, table)) == [] and rows(ranking.rank(odd, table.limit(0))) == []


def test_ranks_take_text_ids_and_ties_by_id(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in "hgfedcbazyxw"], "doc_id string, text string")
    items = spark.createDataFrame([("q", "words")], "item_id string, text string")
    assert [r["doc_id"] for r in sorted(ranking.rank(docs.repartition(4), items, 3).collect(), key=lambda r: r["rank"])] == ["a", "b", "c"]


def test_window_sums_and_harvest_against_plain_sums():
    rng = np.random.default_rng(3)
    term, slot = np.unique(rng.integers(0, 40, (600, 2)), axis=0).T
    impact = rng.integers(1, 5, len(term))
    window = ranking.Window(40, term, slot, impact)
    for _ in range(50):
        asked, least, most = np.unique(rng.integers(0, 60, 8)), int(rng.integers(0, 12)), int(rng.integers(1, 9))
        sums = [int(impact[np.isin(term, asked) & (slot == s)].sum()) for s in range(40)]
        assert window.harvest(asked, least, most) == sorted(((s, v) for s, v in enumerate(sums) if v > least), key=lambda x: (-x[1], x[0]))[:most]
        assert not window.sums.any()


def test_impacts_do_not_overflow():
    assert ranking.impacts(10**8, 10**12, 10**15, np.array([3])).tolist() == [3 * 10**9 // (3000 + 8 * (10 + 90 * 10**20 // 10**15))]


@pytest.mark.parametrize(("chunk", "span", "side", "gather", "sent"), [(1024, 16, 8, 1 << 19, 10**6), (5, 2, 3, 500, 0), (64, 1, 1, 50, 10**6)])
def test_divergence_equals_sql(docs, duck, chunk, span, side, gather, sent, monkeypatch):
    for name, v in (("CHUNK", chunk), ("SPAN", span), ("SIDE", side), ("GATHER", gather), ("SENT", sent)):
        monkeypatch.setattr(divergence, name, v)
    assert rows(divergence.divergence(docs.repartition(3))) == sorted(duck.execute(divergence.ORACLE).fetchall(), key=repr)


@pytest.mark.parametrize("least", [1, 2, 10])
def test_divergence_of_odd_rows(odd, none, least, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST", least)
    c = duckdb.connect()
    c.register("documents", odd.select("text", "lang", "source").toPandas())
    want = c.execute(divergence.ORACLE.replace("count(*) >= 10", f"count(*) >= {least}")).fetchall()
    assert rows(divergence.divergence(odd)) == sorted(want, key=repr)
    assert ("en", "a", "pair", "b") in {r[:4] for r in want} and (least < 10 or {r[4] for r in want if r[2] == "pair"} == {0})
    assert rows(divergence.divergence(none)) == []


def test_shares_of_counts_beyond_64_bits(spark):
    n, total, size = [0, 7, 10**12], 3 * 10**12, 5
    want = [1 + 10**9 * (x + 2) // (total + 2 * size) for x in n]
    assert divergence.shares(np.array(n), total, size).tolist() == want
    df = spark.createDataFrame([(x, total, size) for x in n], "n long, total long, size long")
    assert [r[0] for r in df.select(divergence.share("n", "total", "size")).collect()] == want
