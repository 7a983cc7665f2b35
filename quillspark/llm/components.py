"""Connected components by least labels with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved

#: Labels are sent to the edges up to this number of edges (each label has 16 bytes); beyond it both are shuffled.
SENT = 1_000_000
#: Edges of a partition of a saved table, at least.
PART = 50_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """In as few partitions as so many small rows need."""
    return df.coalesce(max(1, -(-rows // PART)))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, label: the least node that is reachable, for every node of `edges` (a, b), which may repeat or be loops.

    A round takes the least label of the neighbours, then the label of the label, so a path of n edges takes about log2(n) rounds; 64 are more than any table needs. Rows of a node with many edges are
    pre-aggregated on the map side; a join on such a node is one that adaptive execution may split.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()
    both = packed(both, n)
    hint = F.broadcast if n <= SENT else (lambda df: df)
    labels = saved(packed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), n))
    for _ in range(most_rounds):
        there = hint(labels.select(F.col("node").alias("_there"), "label"))
        heard = both.join(there, both["b"] == F.col("_there")).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("_was"))
        low = labels.select("node", "label", F.col("label").alias("_was")).union(heard).groupBy("node").agg(F.min("label").alias("_low"), F.max("_was").alias("_was"))
        up = hint(labels.select(F.col("node").alias("_up"), F.col("label").alias("_top")))
        fresh = saved(packed(low.join(up, low["_low"] == F.col("_up")).select("node", F.least("_low", "_top").alias("label"), "_was"), n))
        changed = fresh.where(F.col("label") != F.col("_was")).limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"labels still changed after {most_rounds} rounds")
