"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform number from MD5; the shard with the least -ln(u) / weight holds the record. A new
shard can only take records over, and takes its share of them. The law is `key`: doc_id and the shards decide.

Odd input: a null text has no bytes (size 8, CRC-32 of nothing: 0); a null doc_id is the key ''; equal doc_ids go to one shard with
different slots, in order of CRC-32 and size (equal rows in any order); texts of any length are read whole; ties of cost go to the lower shard; an empty table gives an empty result; other columns are not read. Slots come from counts per hash bucket
of a shard, so that no shard has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bucket_of, ranked

SHARDS = 24
#: Rows of a shard are ranked within so many buckets.
BUCKETS = 256


def _unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide: 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: a struct with the shard of the first len(weights) - 1 weights and of all of them."""
    costs = [F.struct((-F.log(_unit(key, j)) / F.lit(float(w))).alias("cost"), F.lit(j).alias("shard")) for j, w in enumerate(weights)]
    one = costs[0] if len(costs) == 2 else F.least(*costs[:-1])
    return F.struct(one["shard"].alias("shard"), F.least(one, costs[-1])["shard"].alias("grown"))


def assign(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row. `weights` has one more entry, of the shard
    that would come next."""
    weights = list(weights or [1.0] * (shards + 1))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    data = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("_to"),
        key.alias("_key"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", "law", F.col("_to.shard").alias("shard"), F.col("_to.grown").alias("grown_shard"), "_key")
    rows = ranked(rows, ["shard"], ["_key", "text_crc32", "size"], bucket_of(F.col("_key"), F.col("text_crc32"), F.col("size"), n=BUCKETS), "slot")
    return rows.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))

