"""Personal data: base patterns against plain expressions, the field against enumeration, held-out sentences, and odd input."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from quillspark.llm import personal_data as P

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, spans string, n_email string, base_sha256 string"


def brute_base(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return found


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(4)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert P.base_spans(r["text"]) == brute_base(r["text"])
    pieces = ["a", "b.c", "@", "@", ".", "-", "+", "+1", " ", "_", "%", "é", "1", "22", "256", "4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "(0)", "\n", "x@y.z", "..", "007"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert P.base_spans(text) == brute_base(text), text


def cuts(edges, at=-1):
    """All sets of edges that do not overlap."""
    yield ()
    for e, (i, j, *_) in enumerate(edges):
        if i >= at:
            for rest in cuts(edges, j):
                if all(edges[f][0] >= j for f in rest):
                    yield (e, *rest)


def total(edges, cut, joint):
    return sum(edges[e][3] for e in cut) + sum(joint[int(edges[a][2] == edges[b][2])] for a, b in itertools.pairwise(cut) if edges[a][1] == edges[b][0])


def some_edges(rng):
    edges = {(i := int(rng.integers(0, 6)), i + int(rng.integers(1, 4)), int(rng.integers(0, 3))): float(rng.normal()) for _ in range(9)}
    return [(*k, v) for k, v in sorted(edges.items())]


def test_best_cut_and_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(40):
        edges, joint = some_edges(rng), rng.normal(size=2)
        every = sorted(set(cuts(edges)))
        best = max(total(edges, c, joint) for c in every)
        found = P.best_cut(edges, joint)
        place = {e[:3]: k for k, e in enumerate(edges)}
        assert total(edges, [place[x] for x in found], joint) == pytest.approx(best)
        weights = np.exp([total(edges, c, joint) for c in every])
        log, p, joints = P.marginals([e[:3] for e in edges], np.array([e[3] for e in edges]), joint)
        assert log == pytest.approx(np.log(weights.sum()))
        assert p == pytest.approx([sum(w for c, w in zip(every, weights) if e in c) / weights.sum() for e in range(len(edges))])
        for same in (0, 1):
            held = [sum(edges[a][1] == edges[b][0] and int(edges[a][2] == edges[b][2]) == same for a, b in itertools.pairwise(c)) for c in every]
            assert joints[same] == pytest.approx((np.array(held) * weights).sum() / weights.sum())


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    edges = some_edges(rng)
    scores, joint, plain = np.array([e[3] for e in edges]), rng.normal(size=2), [e[:3] for e in edges]
    _, p, joints = P.marginals(plain, scores, joint)
    for k in range(len(edges)):
        up = P.marginals(plain, scores + 1e-5 * (np.arange(len(edges)) == k), joint)[0] - P.marginals(plain, scores - 1e-5 * (np.arange(len(edges)) == k), joint)[0]
        assert up / 2e-5 == pytest.approx(p[k], abs=1e-5)
    for k in range(2):
        step = 1e-5 * (np.arange(2) == k)
        assert (P.marginals(plain, scores, joint + step)[0] - P.marginals(plain, scores, joint - step)[0]) / 2e-5 == pytest.approx(joints[k], abs=1e-5)


def test_held_out_sentences():
    field = P.trained()
    right = found = wanted = 0
    for text, gold in P.draw(300, seed=77):
        base = P.base_spans(text)
        gold = {(len(P.BASE) + k, s, e) for k, s, e in gold if not any(s < y and x < e for _, x, y in base)}
        got = set(P.likely_spans(text, base, field))
        right, found, wanted = right + len(got & gold), found + len(got), wanted + len(gold)
    assert right / found > 0.93 and right / wanted > 0.93


@pytest.mark.parametrize(("text", "span"), [
    ("Please call (212) 555-0187 before noon.", "likely_phone:12:26"), ("write to anna.berg (at) example (dot) org today", "likely_email:9:41"), ("she was born on 3 March 1980 in a town", "likely_birth:16:28"),
    ("my IBAN DE89 3704 0044 0532 0130 00 please", "likely_account:8:35"), ("Yesterday Mr John Smith was there", "likely_name:13:23"), ("he lives at 12 Baker Street, near us", "likely_address:12:27"), ("her SSN 123-45-6789 was seen", "likely_id:8:19"),
])
def test_sentences_by_hand(text, span):
    assert P.scan_text(text, P.trained())[-1] == span


@pytest.mark.parametrize("text", ["License, version 3. CC BY-NC 4.0.", "in 1984 and 1985-1990", "a value of 12,345.67 at 10:30", 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "he said that 7 of 10 did", "The number 4245100581169931 is long"])
def test_sentences_without_any(text):
    assert P.scan_text(text, P.trained())[-1] == ""


def whole_line_spans(text, field):
    """The field over all tokens of each line at once, without neighbourhoods."""
    base, found, at = P.base_spans(text), [], 0
    taken = sorted(x[1:] for x in base)
    for line in text.split("\n"):
        found += [(len(P.BASE) + k, s, e) for k, s, e in field.best(P.Line(text, at, at + len(line), taken))]
        at += len(line) + 1
    return P.listed(sorted(base + found))


def test_query_is_the_field_over_whole_texts(spark):
    field = P.trained()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = spark.createDataFrame([(10_000 + k, ("filler words here " * 40).join(t for t, _ in P.draw(6, seed=500 + k))) for k in range(30)], docs.schema)
    docs = docs.union(planted)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = P.personal_data(docs).collect()
    assert len(found) == len(texts) and sum("likely" in r["spans"] for r in found) >= 25
    for r in found:
        base = brute_base(texts[r["doc_id"]])
        assert [r[c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(k == x for k, *_ in base) for x in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{P.BASE[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r["spans"] == whole_line_spans(texts[r["doc_id"]], field)


@pytest.mark.parametrize("unit", ["1 ", "a", "a@", "1", "+1", "1.", "Mr A. ", "a at b dot ", "((", "-", "12 Street ", "DE11 "])
def test_long_texts_take_linear_time(unit):
    field = P.trained()
    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        P.scan_text(unit * (n // len(unit)), field)
        took.append(time.perf_counter() - began)
    assert took[1] < max(1.0, 9 * took[0]) and took[1] < 20


def test_odd_rows(spark):
    pad = ("x",) * 4
    rows = [(1, None, *pad), (2, "", *pad), (3, "a@b.co +1 (212) 555-0187 10.0.0.1", *pad), (3, "a@b.co +1 (212) 555-0187 10.0.0.1", *pad), (None, "1.2.3.4", *pad), (5, "é 1.2.3.4", *pad), (None,) * 6]
    found = sorted(map(tuple, P.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert found.count((None, 0, 0, 0, 0, empty, "")) == 1 and (1, 0, 0, 0, 0, empty, "") in found and (2, 0, 0, 0, 0, empty, "") in found
    assert [r[6] for r in found if r[0] == 5] == ["ip:2:9"] and len([r for r in found if r[0] == 3]) == 2
    assert P.personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
