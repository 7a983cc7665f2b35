"""An inverted index that outlives a query: tables in a folder, written in segments and read by the buckets of the terms asked for.

| table | columns | cut by |
|---|---|---|
| rows | slug, seq, nr, attributes, terms, counts, max_tf | segment, bucket of the slug |
| postings | term, and lists of nr and tf of some articles of the segment that hold it | segment, bucket of the term; sorted by term |
| frequencies | term, delta | segment, bucket of the term |
| marks | slug, at | segment, bucket of the slug |
| log | segment, replaces, buckets, live | - |

An upsert writes one segment with the new versions of articles, marks for the versions that they replace and for removed articles, and what both change in the document frequencies. A version is live
while no mark of its slug is later than it. A merge rewrites segments without what is dead in them. A segment counts once its row is in the log, which is written last, so a run that stopped
half-way counts for nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores, text
from quillspark.operators.search import intent, query_tokens
from quillspark.operators.segments import Segmented
from quillspark.session import reach_workers, saved

ATTRIBUTES = ("lifecycle", "doc_type", "type", "sensitivity")
_OF_ROW = ", ".join(f"{a} string" for a in ATTRIBUTES)
SCHEMAS = {
    "rows": f"slug string, seq int, nr long, {_OF_ROW}, terms array<string>, counts array<int>, max_tf int, segment int, bucket int",
    "postings": "term string, nr array<long>, tf array<int>, segment int, bucket int",
    "frequencies": "term string, delta long, segment int, bucket int",
    "marks": "slug string, at int, segment int, bucket int",
}
#: Words of row numbers that are sent to all tasks at most, and postings that a task lists at a time.
SENT, LISTED = 500_000, 2_000_000


def term_arrays(articles: DataFrame, body: str = "body") -> DataFrame:
    """The rows without the body, with their distinct terms, the counts of these and the largest count; counted in Arrow batches, so no token is shuffled."""
    names = [c for c in articles.columns if c != body]

    def count(batches):
        stops, tokens = set(text.STOP_WORDS), re.compile("[a-z0-9]{2,}")
        for b in batches:
            found = []
            for t in b.column(len(names)).to_pylist():
                c = Counter(tokens.findall(t.lower())) if t else Counter()
                for w in stops & c.keys():
                    del c[w]
                found.append(c)
            arrays = pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), pa.array([max(c.values(), default=0) for c in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *arrays], [*names, "terms", "counts", "max_tf"])

    reach_workers(articles.sparkSession)
    kinds = [f"`{c}` {articles.schema[c].dataType.simpleString()}" for c in names]
    return articles.select(*names, body).mapInArrow(count, ", ".join([*kinds, "terms array<string>", "counts array<int>", "max_tf int"]))


def posting_lists(batches):
    """Lists by term of record batches (nr, terms, counts), of a bounded number of postings at a time; all else stays with the rows."""
    for b in batches:
        size = b.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // LISTED
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.slice(lo, hi - lo)
            nr = part.column("nr").take(pa.array(np.repeat(np.arange(hi - lo), size[lo:hi])))
            flat = pa.table({"term": part.column("terms").flatten(), "nr": nr, "tf": part.column("counts").flatten()})
            lists = flat.group_by("term", use_threads=False).aggregate([("nr", "list"), ("tf", "list")])
            yield from pa.table({"term": lists.column("term"), "nr": lists.column("nr_list"), "tf": lists.column("tf_list")}).to_batches()


def bucket_of(term: str, n: int) -> int:
    return zlib.crc32(term.encode()) % n


class TextIndex(Segmented):
    """The index in a folder that Spark can read and write; `buckets` counts where it is new."""

    SCHEMAS = SCHEMAS
    CUT = {"rows": "slug", "marks": "slug", "postings": "term", "frequencies": "term"}

    def live_rows(self, segments: list[int] | None = None) -> DataFrame:
        return self._rows_in(self.table("rows", segments), self._dead(segments), "left_anti")

    def _dead(self, segments: list[int] | None = None) -> DataFrame:
        """segment and nr of the versions that a mark has ended; rows are met by their short columns."""
        marks = self.table("marks").groupBy("slug").agg(F.max("at").alias("at"))
        return self.table("rows", segments).select("segment", "nr", "slug", "seq").join(marks, "slug").where("at > seq").select("segment", "nr")

    def _rows_in(self, rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        """Rows that are among some (segment, nr), or that are not. These are sent to all tasks as words of 64 row numbers, so rows with their terms are not shuffled, and the driver does not hold a slug."""
        bit = lambda: (F.col("nr") % 64).cast("int")
        words = saved(some.groupBy("segment", F.shiftright("nr", 6).alias("_at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit())).alias("_word")))
        few = words.limit(SENT + 1).count() <= SENT
        words = words.withColumnRenamed("segment", "_segment")
        met = (F.col("segment") == F.col("_segment")) & (F.shiftright("nr", 6) == F.col("_at")) & (F.call_function("shiftright", F.col("_word"), bit()).bitwiseAND(F.lit(1)) == 1)
        return rows.join(F.broadcast(words) if few else words, met, how)

    # changes

    def upsert(self, articles: DataFrame | None = None, removed: DataFrame | None = None, body: str = "body") -> int:
        """Articles (slug, body and any of the attributes; a slug once) put in or put in the place of older versions, and slugs taken out. Gives the segment."""
        log = self._log()
        segment, before = (log[-1]["segment"] if log else 0) + 1, self.segments()
        if articles is not None:
            have = [F.col(a).cast("string").alias(a) if a in articles.columns else F.lit(None).cast("string").alias(a) for a in ATTRIBUTES]
            rows = term_arrays(articles.select("slug", *have, F.col(body).alias("body"))).withColumn("seq", F.lit(segment)).withColumn("nr", F.monotonically_increasing_id())
        else:
            rows = self.spark.createDataFrame([], SCHEMAS["rows"])
        self._write("rows", segment, rows, dealt=False)
        rows = self.table("rows", [segment])
        slugs = rows.select("bucket", "slug")
        if removed is not None:
            slugs = slugs.unionByName(removed.select("slug").withColumn("bucket", self._bucket("slug")).select("bucket", "slug"))
        # versions of these slugs that live until now
        short = self.table("rows", before).select("segment", "nr", "bucket", "slug").join(self._dead(before), ["segment", "nr"], "left_anti")
        old = self._rows_in(self.table("rows", before), short.join(slugs.distinct(), ["bucket", "slug"], "left_semi").select("segment", "nr"), "left_semi")
        self._write("marks", segment, old.select("slug", F.lit(segment).alias("at")).distinct())
        self._write_postings(segment, rows)
        added = self.table("postings", [segment]).select("term", F.size("nr").alias("delta"))
        ended = old.select(F.explode("terms").alias("term"), F.lit(-1).alias("delta"))
        delta = added.unionByName(ended).groupBy("term").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        self._write("frequencies", segment, delta)
        self._commit(segment, [], self.live() + rows.count() - self.table("marks", [segment]).count())
        return segment

    def merge(self, segments: list[int] | None = None) -> int:
        """The live rows of some segments, or of all, as one."""
        log, every = self._log(), self.segments()
        some = every if segments is None else [s for s in every if s in segments]
        segment = log[-1]["segment"] + 1
        self._write("rows", segment, self.live_rows(some).withColumn("nr", F.monotonically_increasing_id()), dealt=False)
        self._write_postings(segment, self.table("rows", [segment]))
        delta = self.table("frequencies", some).groupBy("term").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        self._write("frequencies", segment, delta)
        marks = self.table("marks", some) if set(some) != set(every) else self.table("marks", [])
        self._write("marks", segment, marks.groupBy("slug").agg(F.max("at").alias("at")))
        self._commit(segment, some, self.live())
        return segment

    def _write_postings(self, segment: int, rows: DataFrame) -> None:
        reach_workers(self.spark)
        lists = rows.select("nr", "terms", "counts").mapInArrow(posting_lists, "term string, nr array<long>, tf array<int>")
        self._write("postings", segment, lists)

    # questions

    def asked(self, name: str, terms: list[str]) -> DataFrame:
        """Rows of some terms; only the buckets of these are read."""
        return self.table(name).where(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})) & F.col("term").isin(terms))

    def found(self, terms: list[str]) -> DataFrame:
        """term, segment, nr, tf of the articles that hold some of the terms; `_of` tells who they are and which live."""
        return self.asked("postings", terms).select("term", "segment", F.explode(F.arrays_zip("nr", "tf")).alias("x")).select("term", "segment", "x.nr", "x.tf")

    def _of(self, found: DataFrame, *names: str) -> DataFrame:
        """With columns of the live rows that were found; their terms are not read."""
        return self._living(found.join(self.table("rows").select("segment", "nr", "slug", "seq", *names), ["segment", "nr"]))

    def frequencies(self) -> DataFrame:
        """term, df, idf of all terms."""
        df = self.table("frequencies").groupBy("term").agg(F.sum("delta").alias("df")).where("df > 0")
        return df.withColumn("idf", F.log((F.lit(self.live()) + 1) / (F.col("df") + 1)) + 1)

    def search(self, query: str, k: int = 10, where: Column | None = None) -> DataFrame:
        """slug and score of the k best articles, as `search.search` gives them for the live articles; `where` is a condition on the attributes."""
        wanted = Counter(query_tokens(query))
        terms, n = sorted(wanted), self.live()
        df = {r["term"]: r["df"] for r in self.asked("frequencies", terms).groupBy("term").agg(F.sum("delta").alias("df")).collect()} if terms else {}  # a row for each term of the query
        weight = {t: wanted[t] / max(wanted.values()) for t in terms}
        of_term = lambda v: reduce(lambda a, t: F.when(F.col("term") == t, v(t)).otherwise(a), terms, F.lit(0.0))
        idf = of_term(lambda t: F.log(F.lit((n + 1) / (df.get(t, 0) + 1))) + 1)
        part = of_term(lambda t: F.lit(weight[t])) * idf * F.col("tf") * idf
        sums = self._of(self.found(terms).groupBy("segment", "nr").agg(F.sum(part).alias("_p")), "max_tf", *ATTRIBUTES).withColumn("_s", F.col("_p") / F.col("max_tf"))
        if where is not None:
            sums = sums.where(where)
        score = F.col("_s") * scores.lookup(scores.LIFECYCLE_FACTOR, F.col("lifecycle"), 1.0)
        if kind := intent(query):
            score = score * F.when(F.col("doc_type") == kind, 1.5).otherwise(1.0)
        return sums.select("slug", F.round(score, 9).alias("_s")).where("_s > 0").orderBy(F.desc("_s"), "slug").limit(k).select("slug", F.round("_s", 4).alias("score"))

    def holding(self, term: str) -> DataFrame:
        """slug and tf of the articles that hold a term."""
        return self._of(self.found([term])).select("slug", "tf")
