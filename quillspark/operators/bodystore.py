"""Bodies kept apart from their articles: two tables bucketed by slug alike, so that they are joined bucket by bucket without a shuffle.

`bodies` (slug, body) and `articles` (slug, digest of the body as it should be, and what else they have). A change rewrites a table beside the old one and then takes its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def digest(body: str = "body") -> Column:
    return F.sha2(F.col(body).cast("binary"), 256)


def store(rows: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """A table bucketed and sorted by slug."""
    rows.write.mode("overwrite").bucketBy(buckets, "slug").sortBy("slug").saveAsTable(name)


def migrate(articles: DataFrame, articles_name: str, bodies_name: str, buckets: int = BUCKETS) -> None:
    """Articles (slug, body, ...) as two tables."""
    store(articles.select("slug", "body"), bodies_name, buckets)
    store(articles.withColumn("digest", digest()).drop("body"), articles_name, buckets)


def upsert(spark: SparkSession, name: str, changed: DataFrame | None = None, removed: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Rows put in or put in the place of older ones (a slug once), and slugs taken out. Only these are shuffled, to the buckets of the table."""
    old = spark.table(name)
    changed = old.limit(0) if changed is None else changed.select(*old.columns)
    gone = changed.select("slug") if removed is None else changed.select("slug").union(removed.select("slug"))
    store(old.join(gone, "slug", "left_anti").unionByName(changed), f"{name}_next", buckets)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {name}_next RENAME TO {name}")


def verify(spark: SparkSession, articles_name: str, bodies_name: str) -> DataFrame:
    """slug, state of what does not agree: `missing` (no body), `changed` (another body), `extra` (no article)."""
    articles = spark.table(articles_name).select("slug", "digest", F.lit(True).alias("_a"))
    bodies = spark.table(bodies_name).select("slug", "body", F.lit(True).alias("_b"))
    both = articles.join(bodies, "slug", "full_outer")
    state = F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").when(~F.col("digest").eqNullSafe(digest()), "changed")
    return both.select("slug", state.alias("state")).where("state IS NOT NULL")


def restore(spark: SparkSession, articles_name: str, bodies_name: str) -> DataFrame:
    """The articles with their bodies."""
    return spark.table(articles_name).drop("digest").join(spark.table(bodies_name), "slug", "left")
