"""Shared pieces of the operators: checkpoints, words, shingles and distributed ranks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import reach_workers, saved  # noqa: F401


#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PIECE = 1 << 22
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (wraps on purpose)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(text: bytes):
    """Cut a long text at white space so that word lists stay small."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in SPACE:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text, A-Z lower-cased; None is empty."""
    if not text:
        return np.empty(0, np.uint64)
    parts = []
    for piece in pieces(text):
        words = piece.translate(LOWER).split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= _P
        h += words[k : k + m]
    return mix(h + np.uint64(n))


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle, a text without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(ngrams(words, min(n, len(words))))


def binary_column(batch, name: str) -> list:
    """A string column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def bucket_of(*cols: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def ranked(df: DataFrame, group: list[str], order: list[str], bucket: Column, out: str = "rank", add: str | None = None) -> DataFrame:
    """Row numbers from 0 (and, with `add`, running sums before the row, as `<add>_before`) within each group, without
    bringing a group to one task.

    `bucket` is a column that cuts each group into ordered runs: rows are ranked within (group, bucket), and the sums of
    the earlier buckets of the group are joined back. The order is by bucket, then by `order`, which has to be total.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_b", bucket)
    keys = [*group, "_b"]
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(add).alias("_s")] if add else [])
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    tops = df.groupBy(*keys).agg(*sums)
    offsets = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")]
    if add:
        offsets.append(F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    tops = tops.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *offsets)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    within = W.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(within))
    if add:
        df = df.withColumn("_c", F.coalesce(F.sum(add).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    df = df.join(tops, same).withColumn(out, (F.col("_n0") + F.col("_r") - 1).cast("long"))
    if add:
        df = df.withColumn(f"{add}_before", (F.col("_s0") + F.col("_c")).cast("long"))
    return df.drop("_b", "_r", "_c", "_n0", "_s0", *[f"_k{i}" for i in range(len(keys))])


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with workers that can import this package."""
    reach_workers(df.sparkSession)
    return df.mapInArrow(function, schema)
