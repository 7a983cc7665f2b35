"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when at least three quarters of the item's distinct five-word shingles are among the
document's.

1. Items: equal shingle sets are one set. Sets are partitioned by size: partition j holds sizes from 2^j to 2^(j+1) - 1. The sketch of a set with
   s shingles holds its floor(s / 4) + 1 least hashes, in an order in which shingles of many sets come last. A document that holds 75 % of
   the shingles misses at most floor(s / 4), so it shares at least one hash with the sketch: no hit is lost, however long the document.
2. Documents: one pass keeps, of every document, its shingles that may be in a sketch, by a bit filter of bounded size; and if there are any, those that may
   be in an item at all. Only these rows go on, whatever the size of the benchmark.
3. Search: sketch hashes of documents and items are joined; partitions whose sets are too large for the document drop out.
4. Verification: the shingles of the sets found are joined to those of the document and counted.

Odd input: an item without words (or null) is never found; an item with one to four words counts as one shingle of that
length; a null or empty document holds nothing; texts of any length are searched whole; repeated items are listed once, those that share an item_id are
found if one of them is; an item without an item_id counts but is not listed; every row of the documents has its own result, also where doc_ids are repeated or null; with no items
every document is clean; no order enters, so there are no ties; other columns are never read, and `keep_clean` passes them through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import binary_column, map_arrow, ngrams, saved, shingles, word_hashes

WORDS = 5
PERCENT = 75
#: Bits of a filter: at least PER_HASH for a hash, as long as that is within the bounds; fewer bits let more rows through to the joins.
LEAST_BITS, MOST_BITS, PER_HASH = 16, 28, 32
#: Sets that hold a common shingle, at least.
COMMON = 16
#: Digests of contaminated texts that are sent to the documents (32 bytes each); beyond it both are shuffled.
SENT = 500_000


class Filter:
    """Bits of some hashes, two for each."""

    def __init__(self, hashes: DataFrame, n: int, name: str = "h"):
        self.bits = min(MOST_BITS, max(LEAST_BITS, (n * PER_HASH).bit_length()))
        both = F.array(F.col(name).bitwiseAND(F.lit((1 << self.bits) - 1)), F.shiftrightunsigned(name, 64 - self.bits))
        rows = hashes.select(F.explode(both).alias("x")).groupBy(F.shiftright("x", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(F.lit(32767))).alias("m"))
        self.map = np.zeros((1 << self.bits) // 8, np.uint8)
        for r in rows.toLocalIterator():  # at most 2^13 rows of 4096 bytes
            part = np.frombuffer(r["m"], np.uint8)
            at = r["b"] * 4096
            self.map[at : at + 4096] = part[: len(self.map) - at]

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Those of the hashes that may be among the ones known."""
        for x in (lambda h: h & np.uint64((1 << self.bits) - 1), lambda h: h >> np.uint64(64 - self.bits)):
            at = x(hashes)
            hashes = hashes[(self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return hashes


class Items:
    """The shingle sets of a benchmark, in tables: `members` (set, item_id), `sets` (set, n, size, part), `full` (set, h) and
    `sketch` (set, h, part, n)."""

    def __init__(self, items: DataFrame, item_id: str = "item_id", text: str = "text"):
        def read(batches):
            for b in batches:
                texts = binary_column(b, "text")
                full = [shingles(t, WORDS) for t in texts]
                n = [min(WORDS, len((t or b"").split())) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([hashlib.sha256(f.tobytes()).digest() for f in full], pa.binary()), pa.array(n, pa.int32()), pa.array([f.view(np.int64) for f in full], pa.list_(pa.int64()))],
                    ["item_id", "digest", "n", "hashes"],
                )

        rows = map_arrow(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")), read, "item_id long, digest binary, n int, hashes array<long>")
        rows = saved(rows.where("n > 0"))
        self.members = rows.select(F.col("digest").alias("set"), "item_id").distinct()
        once = rows.groupBy(F.col("digest").alias("set")).agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
        once = saved(once.withColumn("size", F.size("hashes")).withColumn("part", F.floor(F.log2("size")).cast("int")))
        self.sets = once.drop("hashes")
        self.full = once.select("set", F.explode("hashes").alias("h"))
        common = self.full.groupBy("h").count().where(F.col("count") >= COMMON).select("h", F.lit(1).alias("_common"))
        order = F.struct(F.coalesce("_common", F.lit(0)).alias("common"), F.xxhash64("h").alias("at"), "h")
        sketch = self.full.join(common, "h", "left").groupBy("set").agg(F.sort_array(F.collect_list(order)).alias("_all"))  # the shingles of one item
        least = F.slice("_all", F.lit(1), (F.size("_all") * (100 - PERCENT) / 100).cast("int") + 1)
        self.sketch = saved(sketch.select("set", F.explode(F.transform(least, lambda x: x["h"])).alias("h")).join(self.sets, "set").select("set", "h", "part", "n"))
        self.lengths = [r["n"] for r in self.sets.select("n").distinct().collect()]  # 1 to WORDS
        self.any = Filter(self.full, self.full.count())
        self.sketched = Filter(self.sketch, self.sketch.count())


def looked_at(docs: DataFrame, items: Items, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, sizes, digest, sketch and held of every row: number of distinct shingles of each length, digest of the text, hashes that may be in a sketch, and hashes that
    may be in an item; but for the first two, nothing where no hash may be in a sketch."""
    shared = docs.sparkSession.sparkContext.broadcast((sorted(items.lengths), items.sketched, items.any))

    def look(batches):
        lengths, sketched, every = shared.value
        for b in batches:
            sizes, digests, sketch, held = [], [], [], []
            for t in binary_column(b, "text"):
                words = word_hashes(t)
                grams = {n: ngrams(words, n) for n in lengths}
                near = [np.unique(sketched.may_hold(g)) for g in grams.values()]
                if not any(map(len, near)):
                    for out in (sizes, digests, sketch, held):
                        out.append(None)
                    continue
                grams = {n: np.unique(g) for n, g in grams.items()}
                sizes.append([len(grams.get(n + 1, ())) for n in range(WORDS)])
                digests.append(hashlib.sha256(t).digest())
                sketch.append(np.concatenate(near).view(np.int64))
                held.append(np.concatenate([every.may_hold(g) for g in grams.values()]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.list_(pa.int32())), pa.array(digests, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int64()))],
                ["doc_id", "sizes", "digest", "sketch", "held"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), look, f"doc_id {kind}, sizes array<int>, digest binary, sketch array<long>, held array<long>")
    return saved(rows.withColumn("row", F.monotonically_increasing_id()))


def hits(seen: DataFrame, items: Items) -> DataFrame:
    """row, set, containment: the sets found in the rows of `looked_at`."""
    near = seen.where("sketch IS NOT NULL")
    pairs = near.select("row", "sizes", F.explode("sketch").alias("h")).join(items.sketch, "h")
    fits = F.element_at("sizes", F.col("n")) * 100 >= F.pow(F.lit(2), F.col("part")) * PERCENT
    pairs = pairs.where(fits).select("row", "set").distinct()
    wanted = pairs.join(items.full, "set").join(near.select("row", F.explode("held").alias("h")), ["row", "h"])
    counted = wanted.groupBy("row", "set").agg(F.count(F.lit(1)).alias("inside")).join(items.sets.select("set", "size"), "set")
    return counted.where(F.col("inside") * 100 >= F.col("size") * PERCENT).select("row", "set", (F.col("inside") / F.col("size")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (sorted), containment (the highest; 0.0 if none reaches the threshold)."""
    known = Items(items)
    seen = looked_at(docs, known)
    found = hits(seen, known).join(known.members, "set").groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("containment").alias("containment"))
    rows = seen.select("row", "doc_id").join(found, F.col("row") == F.col("_row"), "left")
    listed = F.coalesce("items", F.array().cast("array<long>"))
    return rows.select("doc_id", F.col("_row").isNotNull().alias("contaminated"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, with the columns they came with. What is found depends on the text alone, so rows go by its digest."""
    known = Items(items)
    seen = looked_at(docs, known)
    gone = saved(hits(seen, known).select("row").distinct().join(seen.select("row", "digest"), "row").select(F.col("digest").alias("_gone")).distinct())
    if gone.count() <= SENT:
        gone = F.broadcast(gone)
    return docs.join(gone, F.unhex(F.sha2(docs["text"].cast("binary"), 256)) == gone["_gone"], "left_anti")


_words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+')"
#: The same by SQL over the tables of a data folder, with the items as text.
ORACLE = f"""
WITH iw AS (SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT item_id, {_words} AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM iw),
dw AS (SELECT doc_id, {_words} AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM dw, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n),
z AS (SELECT item_id, count(*) AS size FROM ig GROUP BY item_id),
h AS (SELECT doc_id, item_id, CAST(count(*) AS DOUBLE) / any_value(size) AS c FROM dg JOIN ig USING (n, g) JOIN z USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(size)),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(c) AS containment FROM h GROUP BY doc_id)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, coalesce(containment, 0.0) AS containment FROM documents d LEFT JOIN f USING (doc_id)
"""
