"""Point clouds on surfaces, as rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sphere(spark: SparkSession, points: int, radius: float = 1.0, seed: int = 0) -> DataFrame:
    """Uniform on a sphere: normal draws, brought to its radius."""
    xyz = spark.range(points).select("id", F.randn(seed).alias("x"), F.randn(seed + 1).alias("y"), F.randn(seed + 2).alias("z"))
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return xyz.select("id", *[(F.col(c) / n * radius).alias(c) for c in "xyz"])


def torus(spark: SparkSession, points: int, major: float = 2.0, minor: float = 0.5, seed: int = 0) -> DataFrame:
    """On a torus, by two uniform angles."""
    angles = spark.range(points).select("id", (F.rand(seed) * 2 * math.pi).alias("u"), (F.rand(seed + 1) * 2 * math.pi).alias("v"))
    ring = F.lit(major) + F.lit(minor) * F.cos("v")
    return angles.select("id", (ring * F.cos("u")).alias("x"), (ring * F.sin("u")).alias("y"), (F.lit(minor) * F.sin("v")).alias("z"))
