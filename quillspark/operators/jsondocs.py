"""JSON documents in string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_value(doc: Column, path: str) -> Column:
    """The value at a path as text; null if there is none. `$.*` is no path and gives null."""
    return F.lit(None).cast("string") if path.endswith(".*") else F.get_json_object(doc, path)


def array_rows(docs: DataFrame, key: str, doc: str, array: str, field: str | None = None) -> DataFrame:
    """key, pos, value: elements of an array, or a field of each (rows without it are dropped)."""
    items = F.from_json(F.get_json_object(F.col(doc), array), "array<string>")
    rows = docs.select(key, F.posexplode(items).alias("pos", "value"))
    if field is None:
        return rows
    return rows.select(key, "pos", F.get_json_object("value", f"$.{field}").alias("value")).where("value IS NOT NULL")


def query(docs: DataFrame, path: str, key: str = "slug", doc: str = "doc") -> DataFrame:
    """A path with at most one `[*]` step: `$.a.b`, `$.a[*]` or `$.a[*].b`."""
    if "[*]" not in path:
        return docs.select(key, path_value(F.col(doc), path).alias("value")).where("value IS NOT NULL")
    head, _, tail = path.partition("[*]")
    return array_rows(docs, key, doc, head, tail.lstrip(".") or None).select(key, "value")


def doc_stats(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """Size, number of top-level keys, and length of a top-level array."""
    c = F.col(doc)
    return docs.select(key, F.length(c).alias("size"), F.size(F.json_object_keys(c)).alias("n_keys"), F.json_array_length(c).alias("array_length"))


def flattened(doc: Column, longest: int = 2000) -> Column:
    """Keys and leaves of a JSON text as words, without its marks."""
    return F.trim(F.regexp_replace(doc, r'[{}\[\]",:]+', " ")).substr(1, longest)


def list_text(items: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(items)))


def list_from(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
