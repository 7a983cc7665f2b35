"""Numeric and date functions of articles and queues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the engine.
TYPES = ("base", "process", "plan", "help", "research-note", "note", "mission", "procedure")
TYPE_BASE = {"mission": 12, "base": 10, "help": 8, "process": 8, "plan": 6, "procedure": 6, "research-note": 5, "note": 4}
OTHER_BASE = 5
BUDGET = (3, 20)
WORDS_PER_UNIT, LENGTH_FLOOR, LENGTH_CEILING = 600, 0.5, 1.25
REVIEW_DAYS = {"base": 365, "process": 180, "plan": 90, "help": 365, "research-note": 180, "note": 90, "mission": 365}
LIFECYCLE_FACTOR = {"current": 1.0, "superseded": 0.5, "historical": 0.3}
ACCESS_RANK = {"public": 0, "internal": 1, "confidential": 2}
TYPE_GROUP = {"base": 0, "process": 1, "plan": 2, "help": 3, "research-note": 4, "note": 5, "mission": 6}
LIFECYCLE_GROUP = {"current": 0, "superseded": 7, "historical": 14}
RRF_K = 60
# End of fixed values.


def lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(table[key], F.lit(default))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def importance(explicit: Column, confidence: Column, retrievals: Column, lifecycle: Column) -> Column:
    derived = F.lit(1.0) + F.when(confidence >= 0.9, 0.2).otherwise(0.0) + F.when(retrievals >= 10, 0.2).otherwise(0.0) - F.when(lifecycle == "superseded", 0.5).otherwise(0.0)
    return F.when(explicit.isNotNull(), clip(explicit / 3.0, 0.5, 1.5)).otherwise(clip(derived, 0.5, 1.5))


def link_budget(article_type: Column, body_words: Column, importance_: Column) -> Column:
    """Type base times length and importance, half to even, within bounds."""
    length = clip(F.lit(0.5) + body_words / WORDS_PER_UNIT, LENGTH_FLOOR, LENGTH_CEILING)
    return clip(F.bround(lookup(TYPE_BASE, article_type, OTHER_BASE) * length * importance_, 0), *BUDGET).cast("int")


def next_review(start: Column, days: Column) -> Column:
    """Whole years for intervals of a year and more, else days; 29 February becomes the 28th."""
    return F.when(days >= 365, F.add_months(start, (F.floor(days / 365) * 12).cast("int"))).otherwise(F.date_add(start, days.cast("int")))


def review_days(article_type: Column) -> Column:
    return lookup(REVIEW_DAYS, article_type, 365)


def backoff_seconds(attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def access_ok(label: Column, asked: str | None) -> Column:
    if not asked:
        return F.lit(True)
    return lookup(ACCESS_RANK, label, 1) <= ACCESS_RANK.get(asked, 1)


def node_group(article_type: Column, lifecycle: Column) -> Column:
    return lookup(TYPE_GROUP, article_type, 0) + lookup(LIFECYCLE_GROUP, lifecycle, 0)


def tags(article_type: Column, doc_type: Column, lifecycle: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("type/"), article_type), F.concat(F.lit("doc/"), doc_type), F.concat(F.lit("lifecycle/"), lifecycle)))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def metric_label(value: Column, human: tuple[float, float], ai: tuple[float, float]) -> Column:
    """human, ai, overlap, or the range with the nearer centre."""
    in_h, in_a = value.between(*human), value.between(*ai)
    nearer = F.abs(value - sum(human) / 2) < F.abs(value - sum(ai) / 2)
    return F.when(in_h & in_a, "overlap").when(in_h, "human").when(in_a, "ai").when(nearer, "human").otherwise("ai")
