"""The operators against brute force, round trips and held-out accuracy, and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat_format, decontaminate, fingerprints, html_extract, language_id, mixture, near_dedup, queries, repeats, secret_scan, sharding
from quillspark.llm.components import components
from quillspark.llm.html_blocks import blocks

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, label string, size string, rank string, kept string, _b string, _times string"
PAD = ("x",) * 8


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), *PAD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names clash."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    found = [
        doc(1, None), doc(2, ""), doc(3, "   \n\t "), doc(4, "one"), doc(5, "one"), doc(5, "one"), doc(6, "!!! 123 ..."), doc(7, long), doc(8, long + " end"),
        doc(9, "the quick brown fox jumps over the lazy dog", None, None), doc(None, "a text without a number is still a text of words", "fr", "b"), doc(10, "é" * 300), doc(11, "é" * 300, None, "b"),
        (None,) * 13,
    ]
    return spark.createDataFrame(found, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# language identification


def test_language_held_out_accuracy(docs):
    found = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.95
    assert found["score"].between(0, 1).all()


def test_language_held_out_rule(docs):
    for r in language_id.language_id(docs).limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_counts_across_windows():
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(500))
    whole = language_id.counts(text, window=10**6)
    for w in (7, 50, 499):
        assert (language_id.counts(text, window=w) == whole).all()


def test_language_prediction_is_naive_bayes():
    model = language_id.Model(["x", "y"], np.log(np.full((1 << language_id.BITS, 2), 0.5)), np.log([0.25, 0.75]))
    assert model.predict("abc") == ("y", pytest.approx(0.75))
    assert model.predict("123 !") == ("und", 0.0)


def test_language_training_and_scores_against_plain_counts(docs, rows):
    """The matrix from a plain count of all n-grams of the rows that may be learned from, and the scores from sums over n-grams."""
    from collections import Counter
    from math import exp, log

    model = language_id.train(docs)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    learned = [(i, t) for i, t in rows if t is not None and lang[i] is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    plain, seen = {k: Counter() for k in model.languages}, Counter(lang[i] for i, _ in learned)
    assert model.languages == sorted(seen)
    for i, t in learned:
        low = t.lower()
        for n in language_id.ORDERS:
            for p in range(len(low) - n + 1):
                plain[lang[i]][low[p : p + n]] += 1
    grams = sorted(set().union(*plain.values()))
    bucket = {g: int(language_id.buckets(g, (len(g),))[0]) for g in grams}
    for j, k in enumerate(model.languages):
        by = Counter()
        for g, c in plain[k].items():
            by[bucket[g]] += c
        total = sum(by.values()) + 0.5 * 2**language_id.BITS
        for b in (*list(by)[:2000], 0, 17, 32767):
            assert model.log_prob[b, j] == pytest.approx(log((by[b] + 0.5) / total))
        assert model.log_prior[j] == pytest.approx(log(seen[k] / len(learned)))
    some = [t for _, t in rows if t and any(map(str.isalpha, t))][:60]
    names, sure = model.predict_all(some)
    for t, name, p in zip(some, names, sure):
        low = t.lower()
        s = [model.log_prior[j] + sum(model.log_prob[int(b), j] for b in language_id.buckets(low)) for j in range(len(model.languages))]
        assert name == model.languages[s.index(max(s))] and p == pytest.approx(1 / sum(exp(x - max(s)) for x in s), abs=1e-9)


def test_language_odd(odd, none):
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(odd).collect()}
    assert found[1] == found[2] == found[3] == found[6] == "und" and found[4] != "und"
    assert language_id.language_id(odd).count() == odd.count()
    assert language_id.language_id(none).count() == 0
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 7, 8, 9, 10, 11}


# chat formatting


def test_chat_round_trip(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "a\\b\\\\n\\<|turn|>", "<|end|>\n<|turn|>user\nx", "", "\\", "line\nline\n", "<|", "<s><<SYS>>"]
    log = [(1, k, k, "message", r, t) for k, (r, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "we\\ird\nrole\\n<|"))]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    back = chat_format.read_back(chat_format.render(chat_format.fold(events))).collect()
    assert [(t["role"], t["text"]) for t in back[0]["turns"]] == [(x[4], x[5]) for x in log]
    inner = back[0]["formatted"].replace(chat_format.TURN, "").replace(chat_format.END, "")
    assert not any(c in inner for c in chat_format.CONTROLS)


def test_chat_fold_against_loop(spark):
    r, log = random.Random(3), []
    for conv in range(5):
        for seq in range(40):
            log.append((conv, seq, r.randrange(6), r.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]), "assistant", f"<{conv}.{seq}>"))
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    for row in chat_format.fold(events).collect():
        state = {}
        for _, seq, message, kind, _, text in (x for x in log if x[0] == row["conv_id"]):
            first, held = state.get(message, (seq, ""))
            state[message] = (first, {"message": text, "edit": text, "delta": held + text, "regenerate": ""}[kind])
        assert [m["text"] for m in row["messages"]] == [t for _, t in sorted(state.values())]


def test_chat_roles_with_any_characters_come_back(spark):
    roles = ["a\x00\x01b", "x\ny", "\\n", "\\\n", "\\\\n", "<|turn|>", "\\", "\n\\", "<\\|", "</s>\\\n"]
    rows = spark.createDataFrame(list(enumerate(roles)), "i long, role string")
    found = rows.select("i", chat_format.unescape_role(chat_format.escape_role(F.col("role"))).alias("r"), chat_format.escape_role(F.col("role")).alias("e")).collect()
    assert {r["i"]: r["r"] for r in found} == dict(enumerate(roles)) and not any("\n" in r["e"] or "<|" in r["e"] for r in found)


def test_chat_digests_and_odd(spark):
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", "hey", 1), (1, 1, "assistant", "hey", 1), (None, 0, None, "x", 1), (2, None, "assistant", "ü", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message long")
    found = {r["conv_id"]: r for r in chat_format.chat_format(table).collect()}
    assert set(found) == {1, 2, None, -1}
    assert found[1]["n_turns"] == 3 and found[1]["loss_chars"] == 6
    assert found[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nhey\nassistant\nhey\n").hexdigest()
    assert found[2]["loss_sha256"] == hashlib.sha256("ü".encode()).hexdigest()
    assert found[-1]["loss_chars"] == len("</s>[INST] ok [/INST]")
    assert chat_format.chat_format(table.where("false")).count() == 1


# near-duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def chained(seed=0):
    """Texts that drift: neighbours are similar, ends are not; many share one start."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    out, i = [], 1000
    for _ in range(6):
        now = [r.choice(words) for _ in range(60)]
        for _ in range(9):
            out.append((i, " ".join(now)))
            i += 1
            k = r.randrange(55)
            now = now[:k] + [r.choice(words)] + now[k + r.randrange(1, 3) :]
    return out


def test_near_dedup_against_brute_force(spark, rows):
    every = rows + chained()
    want = brute_components(every)
    found = near_dedup.near_dedup(spark.createDataFrame(every, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize(("few", "sent"), [(2, 10**6), (6, 10**6), (6, 0), (64, 10**6)])
def test_near_dedup_large_groups_against_brute_force(spark, few, sent, monkeypatch):
    """A cloud of copies that drifted apart, with keys over and under the limit of pairwise tests, with and without broadcasts."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "SENT", sent)
    r = random.Random(few)
    words = [f"w{k}" for k in range(300)]
    base = [r.choice(words) for _ in range(90)]
    out = []
    for i in range(90):
        now = list(base)
        for _ in range(r.randrange(7)):
            k = r.randrange(len(now))
            now[k : k + 1] = r.choice([[r.choice(words[:4])], [], [now[k], r.choice(words[:4])]])
        out.append((i, " ".join(now)))
    want = brute_components(out)
    found = near_dedup.near_dedup(spark.createDataFrame(out, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == want
    assert 1 < len({c for _, c in want.values()}) < 80


def test_near_dedup_keys_follow_the_pigeonhole():
    r = np.random.default_rng(2)
    one = r.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
    for _ in range(200):  # fewer than 2 * CHUNKS symbols differ
        other = one.copy()
        other[r.choice(near_dedup.SYMBOLS, 2 * near_dedup.CHUNKS - 1, replace=False)] += 1
        assert set(near_dedup.keys(one[None])[0]) & set(near_dedup.keys(other[None])[0])


def test_near_dedup_odd(odd, none):
    found = near_dedup.near_dedup(odd).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[8]["component_id"] == 7 and by[11]["component_id"] == 10
    assert near_dedup.near_dedup(none).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 9, 10, None}


def test_keep_one_goes_by_rows(spark):
    one, two, other = ("the quick brown fox jumps over the lazy dog", "a text of its own with many other words in it", "third of the texts that are not like the rest")
    rows = [(7, one), (3, one), (3, two), (None, one), (None, other), (None, other), (5, two), (5, two), (8, None), (8, None), (9, "x y"), (9, "x y")]
    kept = near_dedup.keep_one(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row long").repartition(3))
    assert kept.columns == ["doc_id", "text", "_row"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, one), (3, two), (None, other), (8, None), (8, None), (9, "x y")], key=repr)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_components_on_paths(spark, sent, monkeypatch):
    import quillspark.llm.components as module

    monkeypatch.setattr(module, "SENT", sent)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and found[100] == found[101] == found[102] == 100


# fingerprints


def test_fingerprints_edited_texts(docs, rows):
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    by_text = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        assert found[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
        assert found[i]["n_chars"] == len(t)
        by_text.setdefault(t, set()).add(found[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    near = np.array([[r["near_edited"], r["near_next"]] for r in found.values()])
    assert near[:, 0].mean() > 0.35 and near[:, 1].mean() < 0.1 and near.min() >= 0 and near.max() <= 1


def test_fingerprint_entries_follow_the_lexicon(spark):
    """Entries by a plain loop over the same hashes."""
    texts = spark.createDataFrame([("a b c d e f g h i j k l m n o p",), ("x y",), ("",), ("x y x",)], "text string")
    bitmap = np.full(fingerprints.SLOTS // 64, -1, np.int64)
    out = fingerprints.with_entries(texts, "text", bitmap, "p_").select("p_a", fingerprints.terms(F.col("text")).alias("t")).collect()
    for r in out:
        assert [e[1:3] for e in r["p_a"]] == [f"{x:02X}" for x in sorted({(h & (2**64 - 1)) >> 58 for h in r["t"]}, key=lambda x: x - 64 if x >= 32 else x)]
    assert out[1]["p_a"] == out[3]["p_a"] and out[2]["p_a"] == []


def test_fingerprint_lexicon_goes_by_terms(spark):
    """More rare terms than slots: none of them is in the lexicon, and all terms of the band are."""
    texts = spark.range(200).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda k: F.concat(F.lit("r"), F.col("id") * 3000 + k)), F.when(F.col("id") % 10 == 0, "in band four words").otherwise("every day")).alias("text"))
    table = fingerprints.lexicon(texts, band=(0.02, 0.15))
    band = {r["h"] for r in spark.sql("SELECT explode(transform(split('in band four words', ' '), t -> xxhash64(t))) AS h").collect()}
    assert {h for at, h in enumerate(table.tolist()) if at in [int(p) for p in fingerprints.place(np.int64(h), len(table))]} == band
    used = fingerprints.with_entries(texts.limit(1), "text", table, "p_").select(F.size("p_a")).first()[0]
    assert used == len({h >> 58 for h in band})
    many = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63, 50_000, np.int64))
    held = fingerprints.table_of(many)
    one, two = fingerprints.place(many, len(held))
    assert ((held[one] == many) | (held[two] == many)).all() and len(held) <= 8 * len(many)


def test_fingerprints_ranges_follow_the_ids(spark):
    """One far-off id and clusters of ids: no range holds more than a few times its share."""
    ids = [*range(3000), *range(10**12, 10**12 + 3000), 10**17, -5, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    placed = [(r["doc_id"], r["b"]) for r in rows.select("doc_id", fingerprints.range_of(rows, 50).alias("b")).collect()]
    known = sorted((i, b) for i, b in placed if i is not None)
    assert [b for _, b in known] == sorted(b for _, b in known) and dict(placed)[None] == -1
    assert max(sum(b == k for _, b in known) for k in {b for _, b in known}) <= 150


def brute_likeness(x, y):
    """By the two fingerprints as they are written: the share of equal entries among the subsets of either, at the better level."""
    p, q = (set(v.split(".")) - {""} for v in (x, y))
    wide = lambda s: {e for e in s if e[0] == "a"}
    if not wide(p) and not wide(q):
        return 1.0
    best = 0.0
    for a, b, least in ((wide(p), wide(q), 1), (p - wide(p), q - wide(q), fingerprints.NARROW_LEAST)):
        subsets = {e[:3] for e in a | b}
        if len(subsets) >= least:
            best = max(best, len(a & b) / len(subsets))
    return best


def test_fingerprints_likeness_against_brute_force(docs):
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(found)
    for i, after in zip(order, [*order[1:], order[0]]):
        r = found[i]
        assert r["near_edited"] == pytest.approx(brute_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(brute_likeness(r["fingerprint"], found[after]["fingerprint"]))


def test_fingerprint_terms_against_brute_force(docs, rows):
    """Which terms are in the lexicon and in which subset they fall, from a plain count of words."""
    low = {i: {w for w in re.split(fingerprints.SPLIT, (t or "").lower()) if w} for i, t in rows}
    words = sorted(set().union(*low.values()))
    spark = docs.sparkSession
    hashed = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    df = {w: 0 for w in words}
    for s in low.values():
        for w in s:
            df[w] += 1
    n = len(rows)
    band = {w for w in words if fingerprints.BAND[0] * n <= df[w] <= fingerprints.BAND[1] * n}
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    for i, s in low.items():
        chosen = s & band if len(s & band) >= fingerprints.LEAST else s
        subsets = {(hashed[w] & (2**64 - 1)) >> (64 - fingerprints.SUBSET_BITS) for w in chosen}
        assert {int(e[1:3], 16) for e in found[i].split(".") if e.startswith("a")} == subsets


def test_fingerprints_odd(odd, none):
    found = fingerprints.fingerprints(odd).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "" and by[1]["near_next"] == 1.0
    assert by[10]["fingerprint"] == by[11]["fingerprint"]
    assert fingerprints.fingerprints(none).count() == 0


def test_fingerprints_order_over_many_ranges(spark):
    ids = [3, 4, 5, 900, 901, 5000, 5001, 5002, 10**12]
    table = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows, _ = fingerprints.with_next(table, per_range=1)
    found = {r["doc_id"]: r["_next"] for r in rows.where("_copy = 0").collect()}
    assert found == {i: f"text {j}" for i, j in zip(ids, ids[1:] + ids[:1])}


# secrets


def brute_secrets(text):
    pattern = r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secrets_against_brute_force(spark, rows):
    extra = [(10**6, "é PassWord = 'abcdefgh1' toKen:short AKIA" + "B" * 12 + " " + "0f" * 16 + " api_key=\"" + "ab12" * 9), (10**6 + 1, "ſecret=abcdefghij")]
    found = secret_scan.secret_scan(spark.createDataFrame(rows + extra, "doc_id long, text string")).collect()
    want = {i: brute_secrets(t) for i, t in rows + extra}
    for r in found:
        w = want[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in w) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in w).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in w} <= set(r["spans"].split(",")) or not w
    assert want[10**6 + 1] == []


def test_secrets_links_need_both_parts():
    key, weak = "AKIA" + "Q" * 16, "aB3/" * 10
    both = secret_scan.scan_text(f"id {key} and {weak} at https://x.amazonaws.com/y")[4]
    assert "linked_secret" in both and "linked_endpoint" in both
    assert secret_scan.scan_text(f"only {weak} at https://x.amazonaws.com/y")[4] == ""
    assert "linked" not in secret_scan.scan_text(f"{key}\n\n\n{weak}")[4]  # another scope


def test_secrets_link_over_the_whole_section(spark):
    key, weak, url = "AKIA" + "Q" * 16, "aB3/" * 10, "https://x.amazonaws.com/y"
    texts = [f"{key}{' x' * 300}\n# a note\naws_secret_access_key = {weak}", f"{key}\n \n{weak} {url}", f"{key}\n\n \r\n{weak}", f"{weak}{' x' * 9000} {key}", f"password={weak} {weak}"]
    rows = secret_scan.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: [x.split(":")[0] for x in r["spans"].split(",")] for r in rows}
    # two secrets are not complementary
    assert found == {0: ["access", "linked_secret"], 1: ["access", "linked_secret", "linked_endpoint"], 2: ["access"], 3: ["linked_secret", "access"], 4: ["assign"]}


def test_secrets_links_go_by_role_and_provider():
    kinds = lambda t: [x.split(":")[0] for x in secret_scan.scan_text(t)[4].split(",")]
    assert kinds("reset your password: hunter2hunter2 then read https://en.wikipedia.org/wiki/Cat") == ["assign"]
    assert kinds("password: hunter2hunter2 x.amazonaws.com " + "aB3/" * 10) == ["assign"]
    assert kinds("host=db.example.org\nuser: bob\npassword: hunter2hunter2") == ["linked_endpoint", "linked_id", "assign"]
    assert kinds("AKIA" + "Q" * 16 + " user: bob host=db.example.org") == ["access"]
    assert kinds("AKIA" + "Q" * 16 + " " + "g" * 40) == ["access"]


def brute_links(text):
    """Every weak part against every base part of its section, by a plain loop over lines."""
    scope, scopes, blank, at = 0, [], 0, 0
    for line in text.split("\n"):
        if line.strip() == "" and at:
            blank += 1
        else:
            scope += blank >= 2
            blank = 0
        scopes.append((at, scope))
        at += len(line) + 1
    of = lambda p: max((a, k) for a, k in scopes if a <= p)[1]
    base = brute_secrets(text)
    out = []
    for name, provider, role, pattern in secret_scan.WEAK:
        for m in pattern.finditer(text):
            s, e = m.span(m.lastindex or 0)
            if any(b <= s and e <= f for _, b, f in base):
                continue
            if any(k in secret_scan.PARTS and secret_scan.PARTS[k][0] == provider and secret_scan.PARTS[k][1] != role and of(b) == of(s) for k, b, _ in base):
                out.append((name, s, e))
    return out


def test_secrets_links_against_brute_force(rows):
    r = random.Random(5)
    parts = ["AKIA" + "Z9" * 8, "aB3/" * 10, "Xy7" * 14, "https://s3.amazonaws.com/b", "password=abcdefgh12", "user: alice", "endpoint = https://api.example.org/v1", "host: db1.example.org", "plain words", "api_key: 'zzzzzzzz9'", "0f" * 20, "https://example.org"]
    texts = ["".join(r.choice(parts) + r.choice([" ", "\n", "\n\n", "\n\n\n", "\n \n\n", " x " * 40]) for _ in range(r.randrange(1, 14))) for _ in range(300)]
    texts += [t for _, t in rows if t and ("AKIA" in t or "password" in t.lower() or "token" in t.lower())]
    linked = 0
    for t in texts:
        want = [(k, s, e) for k, s, e in brute_secrets(t)] + sorted(set(brute_links(t)))
        want.sort(key=lambda x: (x[1], secret_scan.KINDS.index(x[0]), x[2]))
        got = secret_scan.scan_text(t)[4]
        assert got == ",".join(f"{k}:{s}:{e}" for k, s, e in want), t
        linked += "linked" in got
    assert linked > 50


def test_secrets_odd(odd, none):
    assert secret_scan.secret_scan(odd).count() == odd.count() and secret_scan.secret_scan(none).count() == 0


# pages


def test_html_held_out_pages():
    chain, right, total = html_extract.model(), 0, 0
    for found, truth in html_extract.labelled_pages(200, seed=77):
        got = chain.viterbi([chain.emit(f) for f in found])
        right += sum(a == b for a, b in zip(got, truth))
        total += len(truth)
    assert right / total > 0.99


def test_html_viterbi_and_marginals_against_enumeration():
    from itertools import product
    from math import exp

    chain = html_extract.Chain(step=[[0.3, -0.2], [0.1, 0.9]], start=-0.4)
    scores = [0.5, -1.2, 0.3, 2.0, -0.7]

    def score(y):
        return y[0] * chain.start + sum(s for s, k in zip(scores, y) if k) + sum(chain.step[a][b] for a, b in zip(y, y[1:]))

    every = list(product((0, 1), repeat=5))
    assert chain.viterbi(scores) == [bool(x) for x in max(every, key=score)]
    z = sum(exp(score(y)) for y in every)
    content, pairs, _ = chain.marginals(scores)
    for k in range(5):
        assert content[k] == pytest.approx(sum(exp(score(y)) for y in every if y[k]) / z)
    assert pairs[1][1] == pytest.approx(sum(exp(score(y)) * sum(a and b for a, b in zip(y, y[1:])) for y in every) / z)


def test_html_given_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.html_extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        want = [" ".join(html.unescape(x.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def test_html_odd(spark):
    chain = html_extract.model()
    broken = "<article><h1>A &amp; b&nbsp;c</h1><p>First <b>part<br>of it. <p>Second > 'part' < done.<!-- gone --></article><script>x='</p><p>no'</script><footer>&copy; us"
    assert html_extract.extract_text(broken, chain) == "A & b c\n\nFirst part of it.\n\nSecond > 'part' < done."
    assert [b.text for b in blocks("<ul><li>a<li>b</ul>text<p>c")] == ["a", "b", "text", "c"]
    table = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "u", "<<<>>><p", 1), (4, "u", "<p>" * 5000, 1), (4, "u", "x" * 10**6, 1)], "page_id long, url string, html string, text long")
    found = html_extract.html_extract(table).collect()
    assert len(found) == 5 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.html_extract(table.where("false")).count() == 0


# mixture and shards


def test_mixture_targets(docs):
    found = mixture.mix(docs).toPandas()
    total, by = found["size"].sum(), found.groupby(docs.toPandas().set_index("doc_id").loc[found["doc_id"], "source"].to_numpy())
    names = sorted(by.groups)
    weights = dict(zip(names, (5, 2, 1) * len(names)))
    size = by["size"].sum().to_dict()
    open_, want, left = set(names), {}, 1.5 * total
    while open_:  # the contract's rule, step by step
        w = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / w > 2 * size[k]}
        if not full:
            want |= {k: left * weights[k] / w for k in open_}
            break
        for k in full:
            want[k] = 2.0 * size[k]
        left -= sum(want[k] for k in full)
        open_ -= full
    for k in names:
        assert by["target"].first()[k] == pytest.approx(want[k])
        assert by["taken"].sum()[k] == pytest.approx(want[k], rel=0.02, abs=100)
    assert (found["taken"] <= 2 * found["size"]).all()
    assert mixture.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True).equals(found.sort_values("doc_id").reset_index(drop=True))


def test_mixture_is_the_same_with_tables_shuffled(docs, monkeypatch):
    """Tables of sources are sent out or joined; many sources of all sizes."""
    many = docs.withColumn("source", F.concat("source", (F.col("doc_id") % 37).cast("string")))
    want = sorted(map(tuple, mixture.mix(many).collect()))
    monkeypatch.setattr(mixture, "SENT", 0)
    assert sorted(map(tuple, mixture.mix(many).collect())) == want


def test_mixture_odd(odd, none):
    found = mixture.mix(odd)
    assert found.count() == odd.count() and mixture.mix(none).count() == 0
    assert all(r["taken"] <= 2 * r["size"] for r in found.collect())
    kept = mixture.mixed_documents(odd)
    assert kept.columns == odd.columns and kept.count() > 0


def test_schedule_is_low_discrepancy(docs):
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sized = docs.select("doc_id", F.col("source").alias("_src"), mixture.word_count(F.col("text")).alias("size"), key.alias("_key"))
    sources = mixture.targets(sized)
    share = {r["_at"]: r["target"] for r in sources.collect()}
    total = sum(share.values())
    slots = mixture.schedule(sources, 1, 5000).toPandas().sort_values("slot")
    for n in (500, 2000, 5000):
        for k, t in share.items():
            assert abs((slots["_at"][:n] == k).sum() - n * t / total) < 8
    for _, g in slots.groupby("_at"):
        assert g["rank"].tolist() == list(range(len(g)))


def test_shards(docs, rows):
    found = sharding.assign(docs).toPandas()
    for (i, t), r in zip(rows, found.sort_values("doc_id").itertuples()):
        assert r.doc_id == i and r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "key"
    assert ((found["grown_shard"] == found["shard"]) | (found["grown_shard"] == 24)).all()
    for _, g in found.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (sharding.assign(docs, shards=25).toPandas().set_index("doc_id")["shard"].sort_index() == found.set_index("doc_id")["grown_shard"].sort_index()).all()


def test_shards_against_plain_draws(docs):
    """Every record's least cost by a plain loop over the shards, also with weights."""
    from math import log

    def draw(key, weights):
        unit = lambda j: (int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min((-log(unit(j)) / w, j) for j, w in enumerate(weights))[1]

    for weights in (None, [1.0 + j % 3 for j in range(25)]):
        for r in sharding.assign(docs, weights=weights).collect():
            w = weights or [1.0] * 25
            assert r["shard"] == draw(r["doc_id"], w[:-1]) and r["grown_shard"] == draw(r["doc_id"], w)


def test_shards_follow_weights(spark):
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = sharding.assign(table, shards=3, weights=[1.0, 2.0, 1.0, 1.0]).groupBy("shard").count().collect()
    assert {r["shard"]: round(r["count"] / 5000, 1) for r in n} == {0: 1.0, 1: 2.0, 2: 1.0}


def test_shards_odd(odd, none):
    found = sharding.assign(odd).toPandas()
    assert len(found) == odd.count() and not found.duplicated(["shard", "slot"]).any() and sharding.assign(none).count() == 0


# repeated passages


def brute_repeats(rows, n=repeats.LENGTH):
    seen, out = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - n + 1):
            if data[p : p + n] in seen:
                gone[p : p + n] = True
            else:
                seen[data[p : p + n]] = 1
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def repetitive(seed=0):
    r = random.Random(seed)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    line = "".join(r.choice("abcdefgh ") for _ in range(70))
    out = [(k, "".join(r.choice("abcdefghé ") for _ in range(r.randrange(300))) + r.choice([line, passage, passage[: r.randrange(400)], "ab " * 90, "x" * 300]) + "".join(r.choice("ab") for _ in range(r.randrange(200)))) for k in range(60)]
    return out + [(100, passage), (101, passage[:99]), (102, passage[:100]), (103, ""), (104, None)]


@pytest.mark.parametrize("common", [16, 2])
def test_repeats_against_brute_force(spark, common, monkeypatch):
    monkeypatch.setattr(repeats.common_anchors, "__defaults__", (4000, common))
    rows = repetitive()
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_repeats(rows)


@pytest.mark.parametrize(("hot", "index"), [(1, 1 << 19), (3, 1 << 19), (4096, 600)])
def test_repeats_by_single_strings_and_small_blocks(spark, hot, index, monkeypatch):
    """Anchors with more than `hot` segments go by single strings; the result is the same."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "INDEX", index)
    rows = repetitive(7)
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_repeats(rows)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_repeats_keep_to_their_own_text(spark, sent, monkeypatch):
    """Rows that share a doc_id, or have none, but hold different texts are documents of their own."""
    monkeypatch.setattr(repeats, "SENT", sent)
    r = random.Random(3)
    x, y, z = ("".join(r.choice("abcdefgh ") for _ in range(400)) for _ in range(3))
    rows = [(1, x), (7, y), (7, x), (7, z), (None, z), (None, z[:150] + "!" + z[150:]), (9, z)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found), key=repr)
    assert [g for g in got if g[0] is not None] == [(1, 400, 0), (7, 400, 0), (7, 400, 400), (7, 400, 400), (9, 400, 400)]
    assert {k for i, _, k in got if i is None} == {0, 400}  # the earlier one by the hash of its text keeps all


def test_repeats_small_chunks_and_blocks(spark, monkeypatch):
    """Cuts in every place: between pieces of a text, combined segments, and index blocks."""
    rows = repetitive(4)
    batch = lambda: [(i, (t or "").encode()) for i, t in rows]
    parts = [np.concatenate(x) for x in zip(*repeats.segments(batch(), np.empty(0, np.uint64)))]
    covered = sum(int(x) for x in parts[4])
    assert covered == sum(max(0, len(t) - repeats.LENGTH + 1) for _, t in batch())


def test_run_length_index_matches():
    strings = [b"banana" * 30, b"ananas" * 25, b"banana" * 29 + b"x", b"q" * 150]
    index = repeats.RunLengthIndex(strings)
    above, match = index.stream()
    text = b"\0".join(strings) + b"\0"
    assert len(index.run_head) < index.n / 2
    for p in range(0, index.n, 7):
        k = int(match[p])
        a = int(above[p])
        assert text[p : p + k] == text[a : a + k]
    # against a sorted list of suffixes
    r = random.Random(11)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(1, 60))).encode() for _ in range(25)] + [b"ab" * 20] * 3
    index = repeats.RunLengthIndex(strings)
    above, match = index.stream()
    symbols = []
    for k, x in enumerate(strings):
        symbols += [c + len(strings) for c in x] + [k]
    order = sorted(range(index.n), key=lambda p: symbols[p:])
    for x, y in zip(order, order[1:]):
        k = 0
        while x + k < index.n and y + k < index.n and symbols[x + k] == symbols[y + k]:
            k += 1
        assert above[y] == x and match[y] == k


def test_repeats_odd(odd, none):
    found = repeats.remove_repeats(odd).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["n_bytes"] == 0 and by[11]["n_removed"] == 600 and by[10]["n_removed"] == 598
    assert repeats.remove_repeats(none).count() == 0


# decontamination


def brute_leaks(rows, items):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, t in rows:
        w, out[i] = split(t), []
        for j, q in items:
            v = split(q)
            n = min(5, len(v))
            if n:
                want = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
                have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                if 100 * len(want & have) >= 75 * len(want):
                    out[i].append(j)
    return out


@pytest.mark.parametrize(("bits", "common"), [(28, 16), (5, 2)])  # filters of 32 bits let nearly everything through
def test_leaks_against_brute_force(spark, rows, bits, common, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", min(bits, 16))
    monkeypatch.setattr(decontaminate, "COMMON", common)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "the"), (901, None), (902, " "), (903, "of and the")]
    words = items[0][1].split()
    extra = [(5000, "x y z " + " ".join(words[: len(words) - len(words) // 5]) + " q"), (5001, " ".join(words[: len(words) // 2])), (5002, None)]
    found = decontaminate.decontaminate(spark.createDataFrame(rows + extra, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(rows + extra, items)
    assert {r["doc_id"]: r["items"] for r in found} == want and any(want.values())
    assert all(r["contaminated"] == bool(r["items"]) and r["n_items"] == len(r["items"]) for r in found)


def test_leaks_pass_columns_through_whatever_their_names(spark, odd):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    named = odd.withColumnRenamed("key", "_gone").withColumnRenamed("node", "row").withColumnRenamed("label", "digest").withColumnRenamed("size", "set")
    kept = decontaminate.keep_clean(named, items)
    assert kept.columns == named.columns and kept.count() == odd.count() - 1
    assert decontaminate.decontaminate(named, items).where("contaminated").count() == 1


def test_leaks_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", 1)], "item_id long, text string, doc_id long")
    assert {r["doc_id"] for r in decontaminate.decontaminate(odd, items).where("contaminated").collect()} == {9}
    assert decontaminate.keep_clean(odd, items).count() == odd.count() - 1
    assert decontaminate.decontaminate(odd, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.keep_clean(odd, items.where("false")).count() == odd.count()
    assert decontaminate.decontaminate(none, items).count() == 0


@pytest.mark.parametrize("sent", [500_000, 0])
def test_leaks_every_row_has_a_result(spark, odd, none, sent, monkeypatch):
    monkeypatch.setattr(decontaminate, "SENT", sent)
    items = spark.createDataFrame([(3, "one"), (1, "the quick brown fox jumps over the lazy dog"), (2, "a text without a number is still a text of words"), (4, "one")], "item_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in decontaminate.keep_clean(odd, items).collect())
    assert kept == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect() if r["doc_id"] not in (4, 5, 9) and not (r["doc_id"] is None and r["text"]))
    found = sorted(((r["doc_id"], r["items"], r["n_items"], r["containment"]) for r in decontaminate.decontaminate(odd, items).collect()), key=repr)
    some = {4: [3, 4], 5: [3, 4], 9: [1]}
    want = [(r["doc_id"], [2] if r["doc_id"] is None and r["text"] else some.get(r["doc_id"], [])) for r in odd.select("doc_id", "text").collect()]
    assert found == sorted(((i, x, len(x), float(bool(x))) for i, x in want), key=repr) and [x[0] for x in found].count(5) == [x[0] for x in found].count(None) == 2
    assert decontaminate.decontaminate(none, items).count() == 0


# the pipeline


def test_pipeline_stages(spark, docs, rows, tmp_path):
    text = dict(rows)
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before = [r["doc_id"] for r in now.select("doc_id").collect()]
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if name == "language_id":
            assert set(before) - set(ids) == {i for i in before if not any(map(str.isalpha, text[i] or ""))}
        if name == "near_dedup":
            parts = brute_components([(i, text[i]) for i in before])
            assert sorted(ids) == sorted(i for i in before if parts[i][1] == i)
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = brute_leaks([(i, text[i]) for i in before], items)
            assert sorted(ids) == sorted(i for i in before if not leaks[i])
        if name == "mix":
            assert set(ids) <= set(before) and max(ids.count(i) for i in set(ids)) <= 2
        now = after
    assert now.count() == len(before)


def test_pipeline_runs_on_odd_and_empty(spark, odd, none):
    for start in (odd, none):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        now.collect()


def test_every_operator_is_registered():
    names = queries.queries()
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in names if k.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_mix_stage_keeps_near_its_targets(spark):
    """Whole documents, repeated to the nearest number of times: a source's words leave its target by its rounding, 4 % at most on these tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = mixture.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("target").alias("target"))
    words = mixture.mixed_documents(docs).groupBy("source").agg(F.sum(mixture.word_count(F.col("text"))).alias("words"))
    off = targets.join(words, "source").select((F.col("words") / F.col("target") - 1).alias("off")).collect()
    assert len(off) == 20 and max(abs(r["off"]) for r in off) < 0.04
