"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are scored in batches: the n-gram counts of ROWS texts make one sparse matrix (row, bucket, count), whose entries pick rows of the
log-probability matrix, which every executor has.

Rules for odd input: a null text and a text without a letter get `und` and score 0.0; rows with a null language, or from
the held-out quarter, are never learned from; repeated rows are each predicted; a tie goes to the first language by name; an empty table gives an empty result; with
nothing to learn from every text is `und`. Other columns of the input are never read. Texts of any length are scored whole, in windows of
`WINDOW` code points that overlap by the longest n-gram less one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow

ORDERS = (1, 2, 3)
BITS = 15
WINDOW = 1 << 20
UNKNOWN = "und"
#: Training takes this many documents a language on average, chosen by a hash of doc_id; their texts are read whole.
SAMPLE_PER_LANGUAGE = 3000
#: Languages that are learned, the commonest ones: a bound on what the driver and the executors hold (2^BITS numbers a language).
MOST_LANGUAGES = 256
#: Texts of one sparse matrix, and the code points of them together.
ROWS, POINTS = 32, 1 << 18


def buckets(text: str, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Hash buckets of all character n-grams of a lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    primes = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(0x165667B1))
    found = []
    for n in orders:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x01000193, np.uint32)
        for k in range(n):
            h += points[k : k + m] * primes[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        found.append(h >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def counts(text: str, orders=ORDERS, bits: int = BITS, window: int = WINDOW) -> np.ndarray:
    """N-gram counts of a whole text over the hash buckets."""
    total = np.zeros(1 << bits, np.int64)
    for at in range(0, max(len(text), 1), window):
        piece = text[at : at + window]
        total += np.bincount(buckets(piece, orders, bits), minlength=1 << bits)
        if at + window < len(text):  # n-grams across the cut
            for n in orders:
                if n > 1:
                    total += np.bincount(buckets(text[at + window - n + 1 : at + window + n - 1], (n,), bits), minlength=1 << bits)
    return total


def sparse_counts(texts: list[str], orders=ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, bucket, count) of the n-gram counts of some texts, in order of row and bucket."""
    if len(texts) == 1:
        c = counts(texts[0], orders, bits)
        at = np.flatnonzero(c)
        return np.zeros(len(at), np.int64), at, c[at]
    keyed = [buckets(t, orders, bits).astype(np.int64) + (k << bits) for k, t in enumerate(texts)]
    c = np.bincount(np.concatenate(keyed), minlength=len(texts) << bits)
    at = np.flatnonzero(c)
    return at >> bits, at & ((1 << bits) - 1), c[at]


def in_batches(texts: list[str]):
    """Slices of texts of bounded size; a text over the bound is alone."""
    at = 0
    while at < len(texts):
        to, points = at + 1, len(texts[at])
        while to < len(texts) and to - at < ROWS and points + len(texts[to]) <= POINTS:
            points += len(texts[to])
            to += 1
        yield at, to
        at = to


@dataclass
class Model:
    """Languages and a log-probability matrix, buckets by languages; its size depends on `BITS` and the languages alone."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple = ORDERS
    bits: int = BITS

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probabilities, texts by languages, by sparse batches."""
        out = np.tile(self.log_prior, (len(texts), 1))
        for at, to in in_batches(texts):
            row, bucket, n = sparse_counts(texts[at:to], self.orders, self.bits)
            if len(row):
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                out[at + row[first]] += np.add.reduceat(self.log_prob[bucket] * n[:, None], first)
        return out

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of every text and its posterior probability."""
        known = [k for k, t in enumerate(texts) if t is not None and self.languages and any(map(str.isalpha, t))]
        names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            scores = self.scores([texts[k] for k in known])
            best = scores.argmax(axis=1)  # a tie goes to the first language by name
            posterior = 1.0 / np.exp(np.minimum(scores - scores.max(axis=1, keepdims=True), 0.0)).sum(axis=1)
            for k, j, p in zip(known, best.tolist(), posterior.tolist()):
                names[k], sure[k] = self.languages[j], p
        return names, sure

    def predict(self, text: str | None) -> tuple[str, float]:
        names, sure = self.predict_all([text])
        return names[0], sure[0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, orders=ORDERS, bits: int = BITS, smoothing: float = 0.5) -> Model:
    """Learn from a hash sample of the labelled rows outside the held-out quarter.

    What comes to the driver is a count for each language and a matrix of 2^bits counts for each language, of MOST_LANGUAGES at most.
    """
    learn = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in learn.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0), orders, bits)
    languages = sorted(sizes)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])  # null for those not learned
    unit = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = learn.where(unit < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = counts(t, orders, bits)
                totals[k] = totals[k] + c if k in totals else c
        for k, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    rows = map_arrow(chosen, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros((1 << bits, len(languages)))
    if len(rows):
        matrix[rows["bucket"].to_numpy(), rows["lang"].map(languages.index).to_numpy()] = rows["n"].to_numpy()
    log_prob = np.log(matrix + smoothing) - np.log((matrix + smoothing).sum(axis=0))
    prior = np.array([sizes[k] for k in languages], float)
    return Model(languages, log_prob, np.log(prior / prior.sum()), orders, bits)


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score for every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for b in batches:
            names, sure = m.predict_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), predict, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Train on `docs`, then predict all of it."""
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised, with the columns they came with: those without a letter go, and those whose likeliest language has a
    posterior probability under `least`. With nothing to learn from, all go."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.schema.fieldNames().index("text")

    def keep(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(*m.predict_all(b.column(at).to_pylist()))], pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
