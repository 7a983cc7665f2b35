"""A vector index that outlives a query: inverted lists by a k-means quantiser, as tables in segments.

| table | columns | cut by |
|---|---|---|
| vectors | id, seq, vector | segment, list |
| lists | centre, radius, size | segment, list |
| marks | id, at | segment, bucket of the id |

The centres are fitted to at most SAMPLE vectors, and every vector is in the list of its nearest centre. A question reads the lists whose centres have the largest products with it. What was left out is bounded: a
vector of a list is at most `radius` from its centre, so its product with q is at most q.c + |q| * radius. The exact mode reads the lists whose bound reaches the k-th score of the first, and no others.
Lists are packed into groups of about PART vectors (a longer list is several), and a question goes once to each group that has a list of it. A group and a block of questions are worked on together, and give the k best
of the whole group only: what is shuffled does not grow with the number of lists. In the second pass of the exact mode a group gives only scores that reach the k-th of the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.segments import Segmented
from quillspark.session import reach_workers, saved

SAMPLE = 100_000
#: Lists at most: their centres are held by the driver and each task.
LISTS = 16_384
PART, BLOCK = 10_000, 5_000
#: Products that a task holds at a time, whatever the number of lists and questions.
CELLS = 1_000_000
#: Groups and blocks are dealt to so many tasks at most; their rows are few for the work on them, so tasks are not merged by size.
TASKS = 1_000
#: Scores are compared as they are given, in so many places.
PLACES = 6


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pieces(b: pa.RecordBatch, width: int):
    """A batch in stretches of rows of which each has `width` products."""
    step = max(1, CELLS // max(width, 1))
    return (b.slice(k, step) for k in range(0, b.num_rows, step))


def packed(sizes: list[int]) -> np.ndarray:
    """By list its first group and how many it has: a long list has groups of its own, others share one while they are at most PART vectors together."""
    out, group, filled = [], 0, 0
    for n in sizes:
        if filled and filled + n > PART:
            group, filled = group + 1, 0
        parts = max(1, -(-n // PART))
        out.append((group, parts))
        group, filled = (group + parts, 0) if parts > 1 else (group, filled + n)
    return np.array(out, np.int64).reshape(-1, 2)


class Best:
    """The k best of a block of questions among the vectors of a group that has come so far."""

    def __init__(self, k: int):
        self.k, self.asked, self.q = k, [], None

    def ask(self, ids, q, least, lists) -> None:
        self.asked.append((ids.to_numpy(), matrix(q), least.fill_null(-np.inf).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()))

    def _begin(self) -> None:
        self.ids, self.q, self.least, lists, lengths = (np.concatenate(x) for x in zip(*self.asked))
        order = np.argsort(lists, kind="stable")
        self.lists, self.whose = lists[order], np.repeat(np.arange(len(self.ids)), lengths)[order]
        self.score = np.full((len(self.ids), self.k), -np.inf)
        self.found = np.zeros((len(self.ids), self.k), np.int64)

    def meet(self, bucket: int, rows: pa.RecordBatch) -> None:
        """Vectors of one list, for the questions that read it."""
        if not self.asked:
            return
        if self.q is None:
            self._begin()
        who = self.whose[slice(*np.searchsorted(self.lists, [bucket, bucket + 1]))]
        if not len(who):
            return
        q = self.q[who]
        for some in pieces(rows, len(who)):
            products = q @ matrix(some.column(4)).T
            reach = self.least[who]
            if products.shape[1] > self.k and (reach == -np.inf).any():
                reach = np.maximum(reach, np.partition(products, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero(products >= reach[:, None] - 2 * 10.0**-PLACES)
            if len(i):
                self._merge(who[i], np.round(products[i, j], PLACES), some.column(3).to_numpy()[j])

    def _merge(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Into the best; equal scores by id."""
        touched = np.unique(at)
        old = self.score[touched] > -np.inf
        at = np.concatenate([at, np.repeat(touched, old.sum(axis=1))])
        score, ids = np.concatenate([score, self.score[touched][old]]), np.concatenate([ids, self.found[touched][old]])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, score, ids, place = (x[place < self.k] for x in (at, score, ids, place))
        self.score[at, place], self.found[at, place] = score, ids
        self.least[touched] = np.maximum(self.least[touched], self.score[touched, -1])

    def given(self):
        if self.q is not None:
            at, place = np.nonzero((self.score > -np.inf) & (self.score >= np.round(self.least, PLACES)[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[at], self.found[at, place], self.score[at, place])], ["qid", "id", "score"])


class VectorIndex(Segmented):
    """The index in a folder; vectors have one length and no nulls."""

    SCHEMAS = {
        "vectors": "id long, seq int, vector array<float>, segment int, bucket int",
        "lists": "centre array<double>, radius double, size long, segment int, bucket int",
        "marks": "id long, at int, segment int, bucket int",
    }
    CUT = {"vectors": None, "lists": None, "marks": "id"}
    KEY = "id"

    def centres(self) -> np.ndarray:
        """By list; those of the first segment, which later ones share."""
        found = self.table("lists", [self._log()[0]["segment"]]).select("bucket", "centre").orderBy("bucket").collect()  # at most LISTS rows
        return np.array([r["centre"] for r in found])

    def build(self, vectors: DataFrame, lists: int | None = None, seed: int = 7) -> int:
        """The first segment, from (id, vector)."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = vectors.count()
        lists = min(LISTS, lists or max(1, round(n**0.5)))
        sample = vectors.sample(min(1.0, SAMPLE / max(n, 1)), seed) if n > SAMPLE else vectors
        found = KMeans(k=lists, seed=seed, maxIter=10).fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))).clusterCenters()
        return self._put(vectors, np.array(found), 1, 0)

    def upsert(self, vectors: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Vectors (id, vector; an id once) put in or put in the place of older ones, and ids taken out."""
        segment = self._log()[-1]["segment"] + 1
        vectors = self.spark.createDataFrame([], "id long, vector array<float>") if vectors is None else vectors
        ids = vectors.select("id") if removed is None else vectors.select("id").union(removed.select("id"))
        old = self._living(self.table("vectors")).select("id").join(ids.distinct(), "id", "left_semi")
        self._write("marks", segment, old.distinct().withColumn("at", F.lit(segment)))
        return self._put(vectors, self.centres(), segment, self.live() - self.table("marks", [segment]).count())

    def _put(self, vectors: DataFrame, centres: np.ndarray, segment: int, live: int) -> int:
        half = (centres**2).sum(axis=1) / 2

        def assign(batches):
            for b in (p for b in batches for p in pieces(b, len(centres))):
                x = matrix(b.column(1))
                near = (x @ centres.T - half).argmax(axis=1) if len(x) else np.empty(0, int)
                away = np.sqrt(((x - centres[near]) ** 2).sum(axis=1)) if len(x) else np.empty(0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(away, pa.float64())], ["id", "vector", "bucket", "away"])

        reach_workers(self.spark)
        rows = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<float>")).mapInArrow(assign, "id long, vector array<float>, bucket int, away double")
        rows = saved(rows.withColumn("seq", F.lit(segment)))
        self._write("vectors", segment, rows)
        known = self.spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(centres)], "bucket int, centre array<double>")
        sizes = rows.groupBy("bucket").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("size"))
        self._write("lists", segment, known.join(sizes, "bucket", "left").fillna(0, ["radius", "size"]))
        self._commit(segment, [], live + rows.count())
        return segment

    def search(self, questions: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """qid, id, score, rank of the k best by inner product, equal scores by id, for questions (qid, q)."""
        centres = self.centres()
        stats = {r["bucket"]: (r["r"], r["n"]) for r in self.table("lists").groupBy("bucket").agg(F.max("radius").alias("r"), F.sum("size").alias("n")).collect()}  # at most LISTS rows
        radius = np.array([stats[b][0] for b in range(len(centres))])
        groups = packed([stats[b][1] for b in range(len(centres))])
        questions = saved(questions.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q"), F.lit(None).cast("double").alias("least")))
        n = questions.count()
        first = saved(self._best(self._reads(questions, centres, radius, groups, probes, False), groups, k, n))
        if not exact:
            return first
        least = first.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
        more = self._reads(questions.drop("least").join(least, "qid", "left"), centres, radius, groups, probes, True)
        return self._ranked(first.drop("rank").unionByName(self._best(more, groups, k, n).drop("rank")), k)

    def probes(self, share: float = 0.95, k: int = 10, sample: int = 200) -> int:
        """How many lists hold this share of the k best of at most `sample` stored vectors, taken by the hash of their ids."""
        rows = self._living(self.table("vectors")).select("id", "vector", "bucket")
        asked = saved(rows.orderBy(F.xxhash64("id")).limit(sample).select(F.col("id").alias("qid"), F.col("vector").alias("q")))
        answers = self.search(asked, k, exact=True).join(rows.select("id", "bucket"), "id").groupBy("qid").agg(F.collect_list("bucket").alias("lists")).join(asked, "qid").collect()  # k lists for each of the sample
        places, centres = [], self.centres()
        for r in answers:
            order = np.argsort(np.argsort(-(centres @ np.array(r["q"], np.float64)), kind="stable"))
            places += order[r["lists"]].tolist()
        return 1 + int(np.quantile(places, share, method="higher")) if places else 1

    def _reads(self, questions: DataFrame, centres: np.ndarray, radius: np.ndarray, groups: np.ndarray, probes: int, rest: bool) -> DataFrame:
        """qid, q, least, group, lists: what to read for each question, by groups; with `rest`, the lists not read yet whose bound reaches `least`."""

        def choose(batches):
            for b in (p for b in batches for p in pieces(b, len(centres))):
                q = matrix(b.column(1))
                products = q @ centres.T if len(q) else np.empty((0, len(centres)))
                order = np.argsort(-products, axis=1, kind="stable")
                chosen = np.zeros(products.shape, bool)
                np.put_along_axis(chosen, order[:, :probes], True, axis=1)
                if rest:
                    least = np.array([-np.inf if v is None else v for v in b.column(2).to_pylist()])
                    chosen = ~chosen & (products + np.sqrt((q**2).sum(axis=1))[:, None] * radius >= least[:, None] - 10.0**-PLACES) if len(q) else chosen
                at, lists = np.nonzero(chosen)
                times = groups[lists, 1]
                ends = np.cumsum(times)
                at, lists = np.repeat(at, times), np.repeat(lists, times)
                group = groups[lists, 0] + np.arange(len(lists)) - np.repeat(ends - times, times)
                start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (group[1:] != group[:-1])]) if len(at) else np.empty(0, int)  # both ascend
                held = pa.ListArray.from_arrays(pa.array(np.r_[start, len(at)], pa.int32()), pa.array(lists, pa.int32()))
                whose = pa.array(at[start])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(whose) for c in range(3)), pa.array(group[start], pa.int32()), held], ["qid", "q", "least", "group", "lists"])

        return questions.select("qid", "q", "least").mapInArrow(choose, "qid long, q array<double>, least double, group int, lists array<int>")

    def _best(self, reads: DataFrame, groups: np.ndarray, k: int, n: int) -> DataFrame:
        """The k best of each question in the lists to read."""
        reads = saved(reads)
        lists = [r["bucket"] for r in reads.select(F.explode("lists").alias("bucket")).distinct().collect()]  # at most LISTS
        places = F.broadcast(self.spark.createDataFrame([(b, int(g), int(p)) for b, (g, p) in enumerate(groups)], "bucket int, first int, parts int"))
        blocks = max(1, -(-n // max(1, min(BLOCK, CELLS // k))))
        rows = self._living(self.table("vectors").where(F.col("bucket").isin(lists))).join(places, "bucket")  # only these folders are read
        none = lambda kind: F.lit(None).cast(kind)
        data = rows.select(
            (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "bucket",
            "id", "vector", none("array<double>").alias("q"), none("double").alias("least"), none("array<int>").alias("lists"),
        )
        asked = reads.select("group", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("bucket"), F.col("qid").alias("id"), none("array<float>").alias("vector"), "q", "least", "lists")
        tasks = min(blocks * int(groups.sum(axis=1).max()), TASKS)
        rows = data.unionByName(asked).repartition(tasks, "group", "block").sortWithinPartitions("group", "block", "bucket")

        def multiply(batches):
            key, best = None, None
            for b in batches:
                sign = np.stack([b.column(c).to_numpy() for c in range(3)])
                cuts = np.flatnonzero((sign[:, 1:] != sign[:, :-1]).any(axis=0)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                    if lo == hi:
                        continue
                    now = tuple(sign[:2, lo].tolist())
                    if now != key:
                        if best:
                            yield from best.given()
                        key, best = now, Best(k)
                    run = b.slice(lo, hi - lo)
                    if sign[2, lo] < 0:
                        best.ask(run.column(3), run.column(5), run.column(6), run.column(7))
                    else:
                        best.meet(int(sign[2, lo]), run)
            if best:
                yield from best.given()

        reach_workers(self.spark)
        return self._ranked(rows.select("group", "block", "bucket", "id", "vector", "q", "least", "lists").mapInArrow(multiply, "qid long, id long, score double"), k)

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        best = W.partitionBy("qid").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: questions, and the share of the exact answers that were found."""
    hit = found.select("qid", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["qid", "id"], "left").agg(F.countDistinct("qid").alias("questions"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 4).alias("recall"))
