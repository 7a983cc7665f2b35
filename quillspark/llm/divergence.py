"""Source divergence audit: how far the term shares of each source are from those of the other sources of its language, and of the language.

The terms that at least LEAST documents of a language hold are its vocabulary. It is cut by hash into chunks of about CHUNK terms, and the counts of a source in a chunk are packed
into one row. The sources of a language are dealt into blocks of about SIDE, and each pair of blocks is a tile: the packed rows are replicated to the tiles of their block, and a
tile's task holds the sources of two blocks over one chunk at a time, fills in the shares of terms without a count, and adds the divergences of all pairs in it. A tile over more than
SPAN chunks is several tasks, whose sums are added. No task holds a language, a vocabulary or a source whole, and no pair of rows is ever joined.

All arithmetic is in integers: counts in tasks are 64-bit unless a product would not fit, then of any size.

Odd input: null texts, languages and sources are read as ''; a source without terms is a group whose terms all have count 0; a language without vocabulary has pairs with value 0 and
no terms; a language with one source has no pairs; equal values rank by the UTF-8 bytes of the item; repeated rows count each time; texts of any length are read whole; an empty table
gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import binary_column, map_arrow, pieces, saved

LEAST = 10
UNIT = 1_000_000_000
CHUNK = 1024
SPAN = 16
SIDE = 8
#: Rows of sources that are broadcast at most; beyond it they are joined by shuffles.
SENT = 500_000
#: Distinct terms of documents and groups that a task gathers before it hands them on.
GATHER = 1 << 19
#: A to Z become lower case; letters and all bytes of other characters stay; the rest separates terms.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
o AS (SELECT d.lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) d JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS vv FROM k GROUP BY lang),
h AS (SELECT g.lang, source, coalesce(sum(n), 0)::BIGINT AS nn FROM g LEFT JOIN o USING (lang, source) GROUP BY ALL),
c AS (SELECT h.lang, h.source, k.term, coalesce(n, 0) AS n, (1 + (1000000000 * (coalesce(n, 0) + 2)) // (nn + 2 * vv))::BIGINT AS p FROM h JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
l AS (SELECT lang, term, (1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * vv))::BIGINT AS q FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM o GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT c.lang, source, 'term', c.term, ((p - q) * (p - q)) // (p + q) FROM c JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10
"""


def counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, occurrences and documents, gathered in tasks, with a row of the term '' for each group."""

    def count(batches):
        def out(groups):
            for (lang, source), (n, df) in groups.items():
                terms = [b"", *n]
                counts = pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in n)], pa.int64())
                names = (pa.array([x] * len(terms), pa.string()) for x in (lang, source))
                yield pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])

        groups: dict = {}
        held = 0
        for b in batches:
            for lang, source, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), binary_column(b, "text")):
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                own: Counter = Counter()
                for piece in pieces(t.translate(TERMS)):
                    own.update(piece.split())
                n.update(own)
                df.update(own.keys())
                held += len(n) - before
                if held >= GATHER:
                    yield from out(groups)
                    groups, held = {}, 0
        yield from out(groups)

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    return map_arrow(rows, count, "lang string, source string, term string, n long, docs long")


def vocabulary(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n, the term's count in the language, and `first` on one row of each term; a row of the term '' for each group."""
    by_group = counted(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    found = by_group.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("every"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return found.where((F.col("docs") >= LEAST) | (F.col("term") == "")).drop("docs")


def shares(n: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / (total + 2 * size))."""
    if len(n) and int(n.max()) + 2 > (1 << 63) // UNIT:
        return np.fromiter((1 + UNIT * (int(x) + 2) // (total + 2 * size) for x in n), np.int64, len(n))
    return 1 + UNIT * (n + 2) // (total + 2 * size)


def share(n: str, total: str, size: str) -> Column:
    """The same in the plan, in decimals: a language's counts may not fit."""
    whole = "decimal(20,0)"
    return F.expr(f"1 + (cast({n} + 2 AS {whole}) * cast({UNIT} AS decimal(10,0))) div cast({total} + 2 * {size} AS {whole})").cast("long")


class Tile:
    """The pairs of two blocks of sources (or of one with itself) over some chunks of the vocabulary."""

    def __init__(self, key: tuple):
        self.lang, self.first, self.second, self.span = key
        self.totals: dict[str, tuple[int, int]] = {}
        self.sides: tuple[list, list] = [], []
        self.sums: dict[tuple[str, str], int] = {}
        self.chunk: dict[str, np.ndarray] = {}
        self.at, self.size = -1, 0

    def source(self, block: int, name: str, total: int, size: int) -> None:
        self.totals[name] = total, size
        if block == self.first:
            self.sides[0].append(name)
        if block == self.second:
            self.sides[1].append(name)

    def none(self, name: str) -> int:
        """The share of a term without a count."""
        total, size = self.totals[name]
        return 1 + UNIT * 2 // (total + 2 * size) if size else 0

    def base(self, a: str, b: str) -> int:
        p, q = self.none(a), self.none(b)
        return (p - q) ** 2 // (p + q) if p + q else 0

    def counts(self, chunk: int, size: int, name: str, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.at:
            self.add()
            self.at, self.size = chunk, size
        dense = np.full(size, self.none(name), np.int64)
        dense[at - 1] = shares(n, *self.totals[name])
        self.chunk[name] = dense

    def add(self) -> None:
        """The pairs of the chunk that has been read, less what they would have without any count."""
        if self.chunk:
            get = lambda name: self.chunk.get(name, np.full(self.size, self.none(name), np.int64))
            right = np.stack([get(b) for b in self.sides[1]]) if self.sides[1] else np.empty((0, self.size), np.int64)
            for a in self.sides[0]:
                p = get(a)
                for b, v in zip(self.sides[1], ((right - p) ** 2 // (right + p)).sum(axis=1).tolist()):
                    if self.paired(a, b):
                        self.sums[a, b] = self.sums.get((a, b), 0) + v - self.base(a, b) * self.size
        self.chunk = {}

    def paired(self, a: str, b: str) -> bool:
        return self.first != self.second or a < b

    def rows(self) -> list[tuple]:
        """lang, a, b, sum; the first span has every pair, with its value without counts."""
        self.add()
        if self.span == 0:
            for a in self.sides[0]:
                for b in self.sides[1]:
                    if self.paired(a, b):
                        self.sums[a, b] = self.sums.get((a, b), 0) + self.base(a, b) * self.totals[a][1]
        return [(self.lang, a, b, v) for (a, b), v in self.sums.items()]


def tile_sums(batches):
    """lang, a, b and a part of the divergence of each pair of sources; rows come by tile, in it by chunk, the totals of its sources (chunk -1) first."""
    tile, key = None, None

    def out():
        rows = tile.rows() if tile else []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "a", "b", "value"])

    for batch in batches:
        at, n = (batch.column(k).flatten().to_numpy() for k in (10, 11))
        bounds = batch.column(10).offsets.to_numpy() - batch.column(10).offsets[0].as_py()
        for i, (*found, chunk, block, name, total, size, held) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(10)))):
            if found != key:
                yield out()
                tile, key = Tile(found), found
            if chunk < 0:
                tile.source(block, name, total, size)
            else:
                tile.counts(chunk, held, name, at[bounds[i] : bounds[i + 1]], n[bounds[i] : bounds[i + 1]])
    yield out()


def pair_values(terms: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, a, b and their divergence, once for each pair of sources of a language. `terms` has the columns of `sources` joined."""
    chunk = W.partitionBy("lang", "chunk")
    placed = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("at", F.dense_rank().over(chunk.orderBy("term"))).withColumn("held", F.sum(F.col("first").cast("int")).over(chunk))
    packed = placed.groupBy("lang", "chunk", "source", "total", "size", "blocks", "block").agg(F.first("held").alias("held"), F.collect_list(F.struct("at", "n")).alias("x"))
    packed = packed.select("*", F.expr("chunk div %d" % SPAN).cast("int").alias("span"), F.col("x.at").alias("at"), F.col("x.n").alias("n")).drop("x")
    heads = sources.select("*", F.explode(F.sequence(F.lit(0), F.expr("cast((chunks - 1) div %d AS int)" % SPAN))).alias("span"))
    heads = heads.withColumns({"chunk": F.lit(-1), "held": F.lit(0), "at": F.lit([]).cast("array<int>"), "n": F.lit([]).cast("array<long>")})
    rows = packed.unionByName(heads.select(packed.columns)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "span", "chunk", "block", "source", "total", "size", "held", "at", "n")
    rows = rows.repartition("lang", "row", "col", "span").sortWithinPartitions("lang", "row", "col", "span", "chunk", "source")
    return map_arrow(rows, tile_sums, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, most: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: all pairs of sources of a language, and the `most` terms that a source has more often than its language."""
    kept = saved(vocabulary(docs, text, lang, source))
    terms = kept.where("term <> ''")
    langs = terms.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("every").alias("lang_total"))
    groups = kept.where("term = ''").select("lang", "source")
    sources = groups.join(terms.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("others")), "lang").join(langs, "lang", "left")
    sources = sources.fillna(0, ["total", "size", "lang_total"]).withColumns({"chunks": F.greatest(F.lit(1), F.expr("cast((size + %d) div %d AS int)" % (CHUNK - 1, CHUNK))), "blocks": F.expr("cast((others + %d) div %d AS int)" % (SIDE - 1, SIDE))})
    sources = saved(sources.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))
    sent = F.broadcast if sources.count() <= SENT else (lambda df: df)
    terms = terms.join(sent(sources), ["lang", "source"])
    pairs = pair_values(terms, sources)
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    over = terms.withColumns({"p": share("n", "total", "size"), "q": share("every", "lang_total", "size")}).where("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    over = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most)
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(over)
