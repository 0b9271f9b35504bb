"""Connected components by alternating large-star and small-star rounds, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import remove, shared_dir, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Links neighbours of a node to the smallest of them: larger ones, or smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    linked = both.join(least, F.col("a") == F.col("node"))
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link; root is the smallest node reachable. edges: (a, b), any direction.

    Null ends and loops are ignored. Rounds grow with the logarithm of the longest chain; the fingerprint of a
    round's edges (count and sum of hashes) tells when nothing changes.
    """
    spark = edges.sparkSession
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    seen, last = None, None
    while True:
        root = shared_dir(spark)
        grown = written(_stars(current, large=True), "large", root)
        current = written(_stars(grown, large=False), "small", root)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last:
            remove(spark, last)
        last = root
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
