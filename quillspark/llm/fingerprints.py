"""Document fingerprints by I-Match over randomised lexicon subsets, in DataFrame functions only.

Terms are lower-cased words, known by a 64-bit hash. A term belongs to the lexicon if its document frequency lies in
a band of inverse document frequency. Frequencies are counted by the whole hash, however large the vocabulary is; the terms in
the band, which are few, are a cuckoo table that every row is looked up in. The sorted distinct lexicon terms of a
document are split among random subsets of the lexicon (a wide level of SUBSETS disjoint parts, and a narrow level with 1/32 of each for
long texts), and every subset with a term in the document gives one entry: its number and a hash of the terms. The fingerprint is all
entries; the likeness of two is the share of their subsets with equal entries, at the level where it is higher.

Odd input: a null text is empty; a text with fewer than LEAST lexicon terms uses all of its terms; a text without words has an empty
fingerprint, which is like another empty one (1.0) and unlike all others (0.0); rows that repeat a doc_id follow each other in order of text; a null
doc_id sorts first; a single row is followed by itself; texts of any length are taken whole; an empty table gives an empty result; other columns are never read. The next
document is found within ranges of doc_id; the first row of a range also goes to the range before it. Ranges follow the quantiles of doc_id, so ids that are
clustered or far off do not fill one of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Share of documents that hold a lexicon term; as inverse document frequency ln(N / df): 1.9 to 5.8.
BAND = (0.003, 0.15)
LEAST = 4
SUBSET_BITS = 6
SUBSETS = 1 << SUBSET_BITS
NARROW = 31 << SLOT_BITS
#: The narrow level counts where it has so many subsets.
NARROW_LEAST = 6
#: Documents of a range of doc_id on average, and the most ranges (their first ids are broadcast).
RANGE, MOST_RANGES = 512, 200_000
#: Quantiles of doc_id between which ranges are of equal width, in groups of GROUPED, and the error of their ranks.
QUANTILES, GROUPED, RANK_ERROR = 1024, 32, 1 / 20_000
SPLIT = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the words of a text."""
    words = F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


def place(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of hashes in a table of a power of two."""
    return h & (size - 1), (h >> np.int64(32)) & (size - 1)


def table_of(known: np.ndarray) -> np.ndarray:
    """A cuckoo table of distinct hashes: each is at one of its two places, and no other hash is found."""
    size = 1 << max(6, int(5 * len(known) // 2).bit_length())
    while True:
        one, two = (x.tolist() for x in place(known, size))
        held, full = [-1] * size, True
        for k in range(len(known)):
            at = one[k]
            for _ in range(500):
                k, held[at] = held[at], k
                if k < 0:
                    break
                at = two[k] if at == one[k] else one[k]
            else:
                full = False
                break
        if full:
            table = np.full(size, -1, np.int64)
            table[-1] = 0  # an empty place holds a hash that belongs elsewhere
            used = np.array([k >= 0 for k in held])
            table[used] = known[[k for k in held if k >= 0]]
            return table
        size *= 2


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> np.ndarray:
    """The table of the terms in the band. At most 1 / band[0] times the mean number of distinct terms come to the driver."""
    found = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    total = docs.count()
    known = found.groupBy("term").count().where((F.col("count") >= band[0] * total) & (F.col("count") <= band[1] * total)).select("term")
    return table_of(np.sort(np.array([r["term"] for r in known.collect()], np.int64)))


def entries(chosen: Column, starts: Column, mark: str) -> Column:
    """One entry for each run of equal subset numbers among sorted terms; starts: where the runs begin, and the end."""
    run = lambda p, k: F.slice(chosen, p, F.get(starts, k + 1) - p)
    label = lambda p: F.lpad(F.hex(F.shiftrightunsigned(F.element_at(chosen, p), 64 - SUBSET_BITS)), 2, "0")
    return F.transform(F.slice(starts, 1, F.size(starts) - 1), lambda p, k: F.concat(F.lit(mark), label(p), F.lpad(F.hex(F.xxhash64(run(p, k))), 16, "0").substr(1, 4)))


def run_starts(chosen: Column) -> Column:
    """Places of the first term of every subset among sorted terms, and one past the last."""
    subset = lambda p: F.shiftrightunsigned(F.element_at(chosen, p), 64 - SUBSET_BITS)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(chosen), F.lit(1))), lambda p: (p == 1) | (subset(F.greatest(p, F.lit(2))) != subset(F.greatest(p, F.lit(2)) - 1)))
    return F.when(F.size(chosen) == 0, F.array(F.lit(1))).otherwise(F.array_append(places, F.size(chosen) + 1))


def with_entries(df: DataFrame, text: str, table: np.ndarray, out: str) -> DataFrame:
    """Adds <out>a and <out>b, the entries of the wide and the narrow level."""
    lex = F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<long>")  # folded into one literal
    at = lambda h: F.get(lex, h.bitwiseAND(F.lit(len(table) - 1)).cast("int")) == h
    other = lambda h: F.get(lex, F.call_function("shiftright", h, F.lit(32)).bitwiseAND(F.lit(len(table) - 1)).cast("int")) == h
    bit = lambda h: at(h) | other(h)
    df = df.withColumn("_all", terms(F.col(text)))
    df = df.withColumn("_some", F.filter("_all", bit))
    df = df.withColumn("_wide", F.sort_array(F.when(F.size("_some") < LEAST, F.col("_all")).otherwise(F.col("_some")))).drop("_all", "_some")
    df = df.withColumn("_narrow", F.filter("_wide", lambda h: h.bitwiseAND(F.lit(NARROW)) == 0))
    df = df.withColumn("_ws", run_starts(F.col("_wide"))).withColumn("_ns", run_starts(F.col("_narrow")))
    df = df.withColumn(f"{out}a", entries(F.col("_wide"), F.col("_ws"), "a")).withColumn(f"{out}b", entries(F.col("_narrow"), F.col("_ns"), "b"))
    return df.drop("_wide", "_narrow", "_ws", "_ns")


def likeness(x: str, y: str) -> Column:
    """Share of equal entries among the subsets that either fingerprint has, at the better level."""
    number = lambda c: F.transform(c, lambda e: e.substr(1, 3))

    def level(s: str, least: int) -> Column:
        p, q = F.col(f"{x}{s}"), F.col(f"{y}{s}")
        union = F.size(F.array_union(number(p), number(q)))
        return F.when(union >= least, F.size(F.array_intersect(p, q)) / union).otherwise(F.lit(0.0))

    return F.when((F.size(f"{x}a") == 0) & (F.size(f"{y}a") == 0), F.lit(1.0)).otherwise(F.greatest(level("a", 1), level("b", NARROW_LEAST)))


def range_of(ids: DataFrame, per_range: int) -> Column:
    """The number of the range of a doc_id, in ascending order; -1 for null. Which ranges there are changes nothing in the result."""
    rows = ids.count()
    n = max(1, min(QUANTILES, rows // per_range))
    found = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / n for k in range(n)], RANK_ERROR) if rows else []
    low = sorted({int(x) for x in found}) or [0]
    parts = max(1, min(MOST_RANGES, rows // per_range) // len(low))
    width = [max(1, -(-(b - a) // parts)) for a, b in zip(low, [*low[1:], low[-1] + parts])]
    groups = [low[k : k + GROUPED] for k in range(0, len(low), GROUPED)]
    at_or_below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    longs = lambda xs: F.lit(xs).cast("array<long>")
    group = F.greatest(at_or_below(longs([g[0] for g in groups])) - 1, F.lit(0))
    inner = F.get(F.lit(groups).cast("array<array<long>>"), group)
    place = F.greatest(group * GROUPED + at_or_below(inner) - 1, F.lit(0))
    step = F.floor((F.col("doc_id") - F.get(longs(low), place)) / F.get(longs(width), place))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place * parts + F.greatest(F.least(step, F.lit(parts - 1)), F.lit(0))).cast("long")


def with_next(docs: DataFrame, per_range: int = RANGE) -> tuple[DataFrame, W]:
    """doc_id, text, _copy, _next (the next text) and the window they were made with; rows with _copy only stand for the
    row after the last of a range."""
    bucket = range_of(docs.select("doc_id"), per_range)
    firsts = docs.select("doc_id", bucket.alias("_b")).groupBy("_b").agg(F.min("doc_id").alias("_first"))
    order = W.orderBy("_b")  # over at most MOST_RANGES + 2 rows
    last = F.max("_b").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = firsts.select("_first", F.coalesce(F.lag("_b").over(order), last).alias("_before"))
    placed = docs.withColumn("_b", bucket).join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("_before").alias("b"), F.lit(1).alias("copy"))
    placed = placed.select("doc_id", "text", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("_to"))
    placed = placed.select("doc_id", "text", F.col("_to.b").alias("_b"), F.col("_to.copy").alias("_copy"))
    window = W.partitionBy("_b").orderBy("_copy", "doc_id", "text")
    return placed.withColumn("_next", F.lead("text").over(window)), window


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = lexicon(docs)
    rows, window = with_next(docs)
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - moved), F.coalesce(F.col("_next"), F.lit("")).substr(F.lit(1), moved))
    rows = rows.withColumn("_edited", edited).drop("_next")
    rows = with_entries(rows, "text", table, "own_")
    rows = with_entries(rows, "_edited", table, "new_")
    rows = rows.withColumn("next_a", F.lead("own_a").over(window)).withColumn("next_b", F.lead("own_b").over(window)).where("_copy = 0")
    joined = lambda p: F.array_join(F.concat(f"{p}a", f"{p}b"), ".")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        joined("own_").alias("fingerprint"),
        joined("new_").alias("edited_fingerprint"),
        likeness("own_", "new_").alias("near_edited"),
        likeness("own_", "next_").alias("near_next"),
    )
