"""Connected components by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's larger (or smaller) neighbours to the least of them and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    joined = both.join(least, "a")
    moved = joined.where("b > a").select("b", "least") if large else joined.select("b", "least").union(joined.select("a", "least"))
    return moved.toDF("a", "b").where("a != b").distinct()


def labels(edges: DataFrame) -> DataFrame:
    """node, label for every vertex of the edges (a, b): the least vertex it reaches."""
    now, before = stored(edges.select("a", "b").where("a != b").distinct(), "edges"), None
    while True:
        old, now = now, stored(star(star(now, True), False), "stars")
        discard(old)
        # Equal sums of hashes over as many edges: nothing moved.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        before = mark
