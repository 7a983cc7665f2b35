"""Time series: ranges, buckets, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, GAPS = 200, 50


def time_range(df: DataFrame, time: str, start: str, end: str, most: int = 500) -> DataFrame:
    """Rows from start to end, both included, in order of time; `most` is a page size."""
    rest = [c for c in df.columns if c != time]
    return df.where(F.col(time).between(F.lit(start).cast(df.schema[time].dataType), F.lit(end).cast(df.schema[time].dataType))).orderBy(time, *rest).limit(most)


def buckets(df: DataFrame, time: str, unit: str = "hour", most: int | None = BUCKETS, keep_null: bool = True) -> DataFrame:
    """Count, least, greatest and mean of every numeric column by time bucket; unreadable times are one null bucket."""
    at = F.date_trunc(unit, F.col(time).try_cast("timestamp"))
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != time]
    cells = [x for c in numbers for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.round(F.avg(c), 6).alias(f"{c}_avg"))]
    out = df.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *cells)
    out = out if keep_null else out.where("bucket IS NOT NULL")
    return out.orderBy("bucket").limit(most) if most else out


def gaps(df: DataFrame, time: str, expected: float, by: list[str]) -> DataFrame:
    """by, before, after, seconds, missing: steps of more than 1.5 times the expected seconds, within each key."""
    at = F.col(time).cast("timestamp")
    w = W.partitionBy(*by).orderBy(at)
    rows = df.select(*by, at.alias("after"), F.lag(at).over(w).alias("before"))
    step = F.unix_micros("after") - F.unix_micros("before")
    rows = rows.withColumn("seconds", step / 1e6)
    return rows.where(F.col("seconds") > 1.5 * expected).select(*by, "before", "after", "seconds", (F.floor(F.col("seconds") / expected) - 1).cast("long").alias("missing"))


def global_gaps(df: DataFrame, time: str, expected: float, unit: str = "day") -> DataFrame:
    """Gaps over the whole series without one task for all of it: lags within calendar buckets, and the first row of a bucket
    after the last of the one before."""
    at = F.col(time).cast("timestamp")
    rows = df.select(at.alias("after")).where("after IS NOT NULL").withColumn("_b", F.date_trunc(unit, "after"))
    ends = rows.groupBy("_b").agg(F.max("after").alias("_last"))
    ends = ends.select("_b", F.lag("_last").over(W.orderBy("_b")).alias("_prev"))  # one row a bucket
    lagged = rows.withColumn("_lag", F.lag("after").over(W.partitionBy("_b").orderBy("after")))
    rows = lagged.join(ends, "_b").select("after", F.coalesce("_lag", "_prev").alias("before"))
    rows = rows.withColumn("seconds", (F.unix_micros("after") - F.unix_micros("before")) / 1e6)
    return rows.where(F.col("seconds") > 1.5 * expected).select("before", "after", "seconds", (F.floor(F.col("seconds") / expected) - 1).cast("long").alias("missing"))


def series_span(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.min(time).alias("first"), F.max(time).alias("last"))
