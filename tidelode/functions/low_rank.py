"""Merging of low-rank updates into weight matrices, as joins over coordinate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_weights(weight: DataFrame, b: DataFrame, a: DataFrame, alpha: float, rank: int) -> DataFrame:
    """weight + (b a) alpha / rank; each a table of (i, j, v), entries that are missing being 0."""
    product = b.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(a.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    update = product.groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) * (alpha / rank)).alias("v"))
    return weight.select("i", "j", "v").unionByName(update).groupBy("i", "j").agg(F.sum("v").alias("v"))
