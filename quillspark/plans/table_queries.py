"""Time series, JSON and ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import jsondocs as J
from quillspark.operators import timeseries as TS
from quillspark.plans.registry import register
from quillspark.session import table
from quillspark.sources.tables import read_only_sql


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@register(
    "ts_bucket_hour",
    "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, min(value) AS value_min, max(value) AS value_max, round(avg(value), 6) AS value_avg FROM events GROUP BY 1",
)
def ts_bucket_hour(spark, sf_dir):
    return TS.buckets(events(spark, sf_dir).select("ts", "value"), "ts", most=None).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("ts_range", "SELECT ts, event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00' ORDER BY ts, event_id LIMIT 500")
def ts_range(spark, sf_dir):
    return TS.time_range(events(spark, sf_dir).select("ts", "event_id", "value"), "ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00")


_gap = "WITH g AS (SELECT user_id, ts AS after, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT *, CAST(epoch_us(after) - epoch_us(before) AS DOUBLE) / 1000000 AS seconds FROM g)"


@register("ts_gaps", f"{_gap} SELECT user_id, before, after, round(seconds, 3) AS seconds, CAST(floor(seconds / 3600) - 1 AS BIGINT) AS missing FROM s WHERE seconds > 5400")
def ts_gaps(spark, sf_dir):
    out = TS.gaps(events(spark, sf_dir), "ts", 3600.0, ["user_id"])
    return out.select("user_id", F.col("before").cast("timestamp_ntz").alias("before"), F.col("after").cast("timestamp_ntz").alias("after"), F.round("seconds", 3).alias("seconds"), "missing")


@register("ts_gaps_global", "WITH s AS (SELECT ts AS after, lag(ts) OVER (ORDER BY ts) AS before FROM events), d AS (SELECT *, CAST(epoch_us(after) - epoch_us(before) AS DOUBLE) / 1000000 AS seconds FROM s) SELECT before, after, round(seconds, 3) AS seconds, CAST(floor(seconds / 300) - 1 AS BIGINT) AS missing FROM d WHERE seconds > 450")
def ts_gaps_global(spark, sf_dir):
    out = TS.global_gaps(events(spark, sf_dir), "ts", 300.0)
    return out.select(F.col("before").cast("timestamp_ntz").alias("before"), F.col("after").cast("timestamp_ntz").alias("after"), F.round("seconds", 3).alias("seconds"), "missing")


@register("ts_span", "SELECT count(*) AS total_rows, min(ts) AS first, max(ts) AS last FROM events")
def ts_span(spark, sf_dir):
    return TS.series_span(events(spark, sf_dir), "ts")


@register("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_path(spark, sf_dir):
    return J.query(events(spark, sf_dir), "$.k", "event_id", "props")


@register("json_stats", "SELECT event_id, len(props) AS size, len(json_keys(props)) AS n_keys, CASE WHEN json_type(props) = 'ARRAY' THEN json_array_length(props) END AS array_length FROM events")
def json_stats(spark, sf_dir):
    return J.doc_stats(events(spark, sf_dir), "event_id", "props")


def conversation_docs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))), lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["n"].alias("n"))).alias("turns"))).alias("doc"))


@register("json_array_project", "SELECT conv_id, role AS value FROM conversations")
def json_array_project(spark, sf_dir):
    return J.query(conversation_docs(spark, sf_dir), "$.turns[*].role", "conv_id")


@register("json_array_explode", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn FROM conversations")
def json_array_explode(spark, sf_dir):
    rows = J.array_rows(conversation_docs(spark, sf_dir), "conv_id", "doc", "$.turns")
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), F.get_json_object("value", "$.turn").cast("long").alias("turn"))


@register("adhoc_sql", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def adhoc_sql(spark, sf_dir):
    t = {"lineitem": table(spark, sf_dir, "lineitem")}
    return read_only_sql(spark, "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM {lineitem} WHERE l_quantity > ? GROUP BY l_returnflag", [10], tables=t)


@register("table_stats", "SELECT 'orders' AS name, count(*) AS row_count, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders")
def table_stats(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("orders").alias("name"), "row_count", F.lit(",".join(t.columns)).alias("columns"))
