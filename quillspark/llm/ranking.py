"""Ranked lexical search by windowed bucket scoring.

The documents' terms that an item asks for become postings, kept by document. A task sorts its documents by doc_id and cuts them into windows of WINDOW documents; within a window
the postings are turned around to lists by term, and each item adds the impacts of its terms' lists to an array of WINDOW sums that stays in the processor's cache, with a bitset
of the slots that any list has touched. The occupied slots are harvested into a heap of the item's best documents so far, and the heaps of all tasks are cut to the best in two
steps, so that no task sees more than BUCKETS heaps of an item.

Items are taken in blocks of about BLOCK (item, term) pairs; one block's terms, and an item's own, are what the driver and the tasks hold. Statistics (documents, all terms,
documents a term) are counted over all rows.

Odd input: rows without any term (null or empty text, white space, signs) are no documents and are never listed; items without terms, or whose terms no document holds, have no
rows; rows that share an item_id are one item with the terms of all; rows that repeat a doc_id are documents of their own and rank next to each other; documents of equal score
rank by doc_id, a null one last; null item_ids are one item; texts of any length are read whole; empty tables give an empty result. Other columns are never read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import binary_column, bucket_of, map_arrow, pieces, saved

WINDOW = 4096
BLOCK = 1 << 19
BUCKETS = 64
#: A to Z become lower case; letters, digits and all bytes of other characters stay; the rest separates terms.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
e AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM e),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM e) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
x AS (SELECT doc_id, p.term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))) AS v FROM p JOIN f USING (term), s),
r AS (SELECT item_id, doc_id, sum(v)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY ALL HAVING sum(v) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r
QUALIFY rank <= 10
"""


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of the terms of a whole text."""
    found: Counter = Counter()
    for piece in pieces((text or b"").translate(TERMS)):
        found.update(piece.split())
    return found


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item_id, term) pairs."""

    def cut(batches):
        for b in batches:
            for i, t in enumerate(binary_column(b, "text")):
                if terms := list(term_counts(t)):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(terms))), pa.array(terms, pa.binary())], ["item_id", "term"])

    kind = items.schema[item_id].dataType.simpleString()
    return map_arrow(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), cut, f"item_id {kind}, term binary").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n and the ids and counts of the terms that the block asks for, for each row with a term."""

    def count(batches):
        asked = vocabulary.keys()
        for b in batches:
            keep, sizes, ids, counts = [], [], [], []
            for i, t in enumerate(binary_column(b, "text")):
                if not (found := term_counts(t)):
                    continue
                mine = [(vocabulary[x], found[x]) for x in found.keys() & asked]
                keep.append(i)
                sizes.append(found.total())
                ids.append([x for x, _ in mine])
                counts.append([x for _, x in mine])
            kinds = pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *(pa.array(x, k) for x, k in zip((sizes, ids, counts), kinds))], ["doc_id", "n", "ids", "counts"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), count, f"doc_id {kind}, n long, ids array<int>, counts array<int>")


def statistics(lists: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and the documents holding each of the block's terms."""

    def add(batches):
        docs = total = 0
        held = np.zeros(terms, np.int64)
        for b in batches:
            docs += b.num_rows
            total += sum(b.column(0).to_pylist())
            held += np.bincount(b.column(1).flatten().to_numpy(zero_copy_only=False), minlength=terms)[:terms].astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[docs, total], held[at]]))], ["id", "n"])

    found = {r["id"]: r["n"] for r in map_arrow(lists.select("n", "ids"), add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    return found.get(-2) or 0, found.get(-1) or 0, np.fromiter((found.get(k, 0) for k in range(terms)), np.int64, terms)


class Window:
    """The postings of up to `width` documents as lists by term, with the bits of each list's slots."""

    def __init__(self, width: int, term: np.ndarray, slot: np.ndarray, impact: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.slot, self.impact = slot[order], impact[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(term))
        self.sums = np.zeros(width, np.int64)
        self.bits = np.zeros((len(self.terms), (width + 7) // 8), np.uint8)
        touched = np.zeros(width, bool)
        for k in range(len(self.terms)):
            touched[:] = False
            touched[self.slot[self.bounds[k] : self.bounds[k + 1]]] = True
            self.bits[k, :] = np.packbits(touched)

    def harvest(self, asked: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
        """(slot, sum) of the `most` largest sums above `least` for the terms asked for, equal sums by slot."""
        at = np.searchsorted(self.terms, asked)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == asked)] if len(self.terms) else at[:0]
        if not len(at):
            return []
        for k in at:
            lo, hi = self.bounds[k], self.bounds[k + 1]
            self.sums[self.slot[lo:hi]] += self.impact[lo:hi]
        occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bits[at], axis=0), count=len(self.sums)))
        sums = self.sums[occupied]
        self.sums[occupied] = 0
        over = sums > least
        occupied, sums = occupied[over], sums[over]
        if len(sums) > most:
            kth = np.partition(sums, len(sums) - most)[len(sums) - most]
            occupied, sums = occupied[sums >= kth], sums[sums >= kth]
        best = np.lexsort((occupied, -sums))[:most]
        return list(zip(occupied[best].tolist(), sums[best].tolist()))


def impacts(n: int, docs: int, total: int, tf: np.ndarray) -> np.ndarray:
    """A term's share of the score by its count in a document of n terms; the length's part in integers of any size."""
    m = 100 - 90 + (90 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def best_of_task(items: list[np.ndarray], names: pa.Array, weights: np.ndarray, docs: int, total: int, most: int):
    """A function from batches to item_id, doc_id and score of each item's best documents of a task; rows come by doc_id."""
    width = WINDOW

    def score(batches):
        heaps: list[list] = [[] for _ in items]
        seen, rows = 0, []

        def scored():
            term = np.concatenate([i for _, _, i, _ in rows])
            slot = np.repeat(np.arange(len(rows)), [len(i) for _, _, i, _ in rows])
            window = Window(width, term, slot, np.concatenate([impacts(n, docs, total, c) for _, n, _, c in rows]) * weights[term])
            for heap, asked in zip(heaps, items):
                for s, v in window.harvest(asked, heap[0][0] if len(heap) == most else 0, most):
                    (heapq.heappush if len(heap) < most else heapq.heappushpop)(heap, (v, -(seen + s), rows[s][0]))

        for b in batches:
            ids, counts = (b.column(k).flatten().to_numpy() for k in (2, 3))
            bounds = b.column(2).offsets.to_numpy() - b.column(2).offsets[0].as_py()
            for i, n in enumerate(b.column(1).to_pylist()):
                at = slice(bounds[i], bounds[i + 1])
                rows.append((b.column(0)[i], n, ids[at].astype(np.int64), counts[at].astype(np.int64)))
                if len(rows) == width:
                    scored()
                    seen += len(rows)
                    rows = []
        if rows:
            scored()
        found = [(i, d, v) for i, heap in enumerate(heaps) for v, _, d in heap]
        if found:
            ids = pa.array([d.as_py() for _, d, _ in found], found[0][1].type)
            yield pa.RecordBatch.from_arrays([names.take(pa.array([i for i, *_ in found])), ids, pa.array([v for *_, v in found], pa.int64())], ["item_id", "doc_id", "score"])

    return score


def best(found: DataFrame, most: int) -> DataFrame:
    """The best of each item by buckets of documents, then of these."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("_b", bucket_of(F.col("doc_id"), n=BUCKETS))
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "_b").orderBy(*order))).where(F.col("rank") <= most)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, most: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the `most` best documents of each item, with scores above 0."""
    pairs = saved(item_terms(items, item_id, text))
    blocks = max(1, -(-pairs.count() // BLOCK))
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    results = []
    for k in range(blocks):
        block = pairs.where(bucket_of(F.col("item_id"), n=blocks) == k).toArrow()  # about BLOCK rows
        if not block.num_rows:
            continue
        coded = pc.dictionary_encode(pa.chunked_array(block.column("item_id").chunks).combine_chunks(), null_encoding="encode")
        terms = block.column("term").to_pylist()
        vocabulary = {t: i for i, t in enumerate(sorted(set(terms)))}
        ids, which = np.fromiter((vocabulary[t] for t in terms), np.int64, len(terms)), coded.indices.to_numpy()
        order = np.argsort(which, kind="stable")
        asked = np.split(ids[order], np.flatnonzero(np.diff(which[order])) + 1)
        lists = saved(postings(docs, vocabulary, doc_id, text))
        n_docs, total, held = statistics(lists, len(vocabulary))
        weights = np.fromiter((math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in held), np.int64, len(held))
        score = best_of_task(asked, coded.dictionary, weights, n_docs, total, most)
        results.append(map_arrow(lists.sortWithinPartitions(F.col("doc_id").asc_nulls_last()), score, f"item_id {kinds[1]}, doc_id {kinds[0]}, score long"))
    if not results:
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    return best(reduce(DataFrame.unionByName, results), most)
