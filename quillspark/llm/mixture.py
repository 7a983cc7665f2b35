"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in a hash order, form a stream that is cut into blocks of equal length. Slot i of the
schedule has the point frac(i * golden ratio); the point falls into the source whose span of the cumulative target holds
it. The slots of a source are ranked, and rank r takes block r mod (number of blocks) of the source. Any stretch of
the schedule has every source near its weight.

Words are counted in one pass over the texts, which is written as one short row a document; all later steps read that.

Odd input: a null text or one without words has size 0 and is taken for 0; null sources form one source, last in order and in weight; repeated rows
count each, and `mixed_documents` gives each as often as the one that is taken most; ties of the hash order go by doc_id and size, and rows that agree in all three may
change places; a very long text covers several blocks; an empty table gives an empty result; other columns are not read, and `mixed_documents` passes them
through. Blocks have BLOCK words, or fewer where that would leave less than LEAST_SLOTS slots. Targets: 150 % of all words shared by weights 5, 2, 1, repeating over the
sources in order of code points, a target being at most twice the source's size and the excess reshared by weight.
No source, however hot, passes through one task: streams and ranks come from bucket sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, ranked, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of a block, unless that gives fewer than LEAST_SLOTS slots.
BLOCK = 1024
LEAST_SLOTS = 65536
GOLDEN = 0.6180339887498949
#: Hexadecimal digits of the hash order that cut a source into runs.
RUN_DIGITS = 3
SLOT_RUN = 4096
#: Cells of the unit interval by which points find the span that holds them, and sources up to which their table is sent out (80 bytes each).
CELLS = 4096
SENT = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """One row a source: _src, source_size, target, and the span [low, high) of its share of the mix.

    With sources ordered by cap / weight, those before the first that its share does not fill get their cap, the others
    share the rest by weight.
    """
    sources = sized.groupBy("_src").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("_src").isNull(), F.encode("_src", "utf-8"))
    sources = sources.withColumn("_at", F.row_number().over(named) - 1).withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_at") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    sources = sources.withColumn("_cap", F.col("source_size") * float(MOST))
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_at")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(SHARE)
    sources = sources.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    sources = sources.withColumn("_level", F.first(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    sources = sources.withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), F.col("_cap")))
    low = F.coalesce(F.sum("target").over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return sources.select("_src", "_at", "source_size", "target", low.alias("_low"), (low + F.col("target")).alias("_high"))


def small(df: DataFrame, n: int) -> DataFrame:
    """Sent out if it has at most SENT rows."""
    return F.broadcast(df) if n <= SENT else df


def schedule(sources: DataFrame, block: int, slots: int) -> DataFrame:
    """slot, _at (the source), rank: which source each slot takes from, and how many times that was done before.

    Spans are listed by the cells of the unit interval that they touch, so a point is held against the spans of its cell.
    """
    spark = sources.sparkSession
    some = sources.where(F.col("target") > 0)
    total = some.agg(F.max("_high").alias("_all"), F.max("_at").alias("_top"))
    spans = some.crossJoin(F.broadcast(total)).select("_at", (F.col("_low") / F.col("_all")).alias("_from"), (F.col("_high") / F.col("_all")).alias("_to"), (F.col("_at") == F.col("_top")).alias("_end"))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1))
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), F.when(F.col("_end"), F.lit(CELLS - 1).cast("long")).otherwise(cell(F.col("_to"))))))
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    point = point - F.floor(point)
    taken = spark.range(slots).select("id", point.alias("_point")).withColumn("_cell", cell(F.col("_point")))
    taken = taken.join(small(spans, sources.count() + CELLS), "_cell")
    taken = taken.where((F.col("_from") <= F.col("_point")) & ((F.col("_point") < F.col("_to")) | F.col("_end")))
    return ranked(taken.select(F.col("id").alias("slot"), "_at"), ["_at"], ["slot"], F.floor(F.col("slot") / SLOT_RUN), "rank")


def mix(docs: DataFrame, seed: str = "mix", block: int | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("_src"), word_count(F.col(text)).alias("size"), key.alias("_key"))
    sized = saved(sized)  # counted once, one short row a document
    total = sized.agg(F.sum("size")).first()[0] or 0
    sources = saved(targets(sized))
    n = sources.count()
    if not total:
        return sized.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    block = block or int(min(BLOCK, max(1, total * SHARE // LEAST_SLOTS)))
    slots = round(total * SHARE / block)
    streams = ranked(sized, ["_src"], ["_key", "doc_id", "size"], F.substring("_key", 1, RUN_DIGITS), "_row", add="size")
    known = small(sources.select(F.col("_src").alias("_s"), "_at", "source_size", "target"), n)
    streams = streams.join(known, F.col("_src").eqNullSafe(F.col("_s")))
    streams = streams.select("doc_id", "_at", "size", "source_size", "target", "size_before", "_row")
    pieces = streams.where(F.col("size") > 0).withColumn("_block", F.explode(F.sequence(F.floor(F.col("size_before") / block), F.floor((F.col("size_before") + F.col("size") - 1) / block))))
    words = F.least(F.col("size_before") + F.col("size"), (F.col("_block") + 1) * block) - F.greatest(F.col("size_before"), F.col("_block") * block)
    counts = small(sources.select(F.col("_at").alias("_a"), F.ceil(F.col("source_size") / block).alias("_blocks")), n)
    uses = schedule(sources, block, slots).join(counts, F.col("_at") == F.col("_a"))
    uses = uses.where(F.col("rank") < MOST * F.col("_blocks"))  # a block is never taken more often than a source may be
    uses = uses.groupBy("_at", (F.col("rank") % F.col("_blocks")).alias("_block")).agg(F.count(F.lit(1)).alias("_times"))
    taken = pieces.select("_at", "_block", "_row", words.alias("_words")).join(uses, ["_at", "_block"]).groupBy("_at", "_row").agg(F.sum(F.col("_words") * F.col("_times")).alias("taken"))
    out = streams.join(taken, ["_at", "_row"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows: a document is repeated as often as it is taken (to the nearest whole, once if in part); documents not taken go."""
    taken = mix(docs).where(F.col("taken") > 0).select(F.col("doc_id").alias("_id"), F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int")).alias("_times"))
    taken = taken.groupBy("_id").agg(F.max("_times").alias("_times"))
    rows = docs.select(F.struct("*").alias("_row"))  # in a struct, other columns can have any name
    copies = rows.join(taken, F.col("_row.doc_id").eqNullSafe(F.col("_id"))).select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select("_row.*")


#: The same by SQL, for the documents of a data folder.
ORACLE = f"""
WITH d AS (SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size,
                  md5('mix:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
p AS (SELECT CAST(sum(size) AS BIGINT) AS total, greatest(1, least({BLOCK}, CAST(floor(sum(size) * {SHARE} / {LEAST_SLOTS}) AS BIGINT))) AS b FROM d),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS a FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][CAST(a % 3 + 1 AS INT)] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, ((SELECT total FROM p) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2),
s4 AS (SELECT *, first_value(CASE WHEN lv * w <= cap THEN lv END IGNORE NULLS) OVER (ORDER BY cap / w, a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l2 FROM s3),
s5 AS (SELECT *, coalesce(least(cap, l2 * w), cap) AS target FROM s4),
s6 AS (SELECT *, coalesce(sum(target) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low FROM s5),
s AS (SELECT src, a, source_size, target, low / m AS f, (low + target) / m AS t, low + target >= m AS e, CAST(ceil(source_size / (SELECT b FROM p)) AS BIGINT) AS nb FROM s6, (SELECT max(low + target) AS m FROM s6)),
q AS (SELECT i AS slot, (i + 1) * {GOLDEN}::DOUBLE - floor((i + 1) * {GOLDEN}::DOUBLE) AS x FROM range((SELECT CAST(round(total * 1.5::DOUBLE / b) AS BIGINT) FROM p)) r(i)),
u0 AS (SELECT slot, max(a) AS a FROM q JOIN s ON f <= x AND (x < t OR e) AND target > 0 GROUP BY slot),
u1 AS (SELECT a, row_number() OVER (PARTITION BY a ORDER BY slot) - 1 AS r FROM u0),
u AS (SELECT a, r % nb AS blk, count(*) AS times FROM u1 JOIN s USING (a) WHERE r < 2 * nb GROUP BY 1, 2),
st AS (SELECT d.*, a, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY a ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0 FROM d JOIN s ON d.src IS NOT DISTINCT FROM s.src),
pc AS (SELECT doc_id, a, s0, size, unnest(range(s0 // (SELECT b FROM p), (s0 + size - 1) // (SELECT b FROM p) + 1)) AS blk FROM st WHERE size > 0),
tk AS (SELECT doc_id, sum((least(s0 + size, (pc.blk + 1) * (SELECT b FROM p)) - greatest(s0, pc.blk * (SELECT b FROM p))) * times) AS taken FROM pc JOIN u ON pc.a = u.a AND pc.blk = u.blk GROUP BY doc_id)
SELECT st.doc_id, st.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM st LEFT JOIN tk USING (doc_id)
"""
