"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import blocks as B


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``(a, b)``; answers edges with a > b."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    return (small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges`` (a, b) but the roots; a root is its component's smallest node."""
    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = B.scratch_table(spark, edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while (now := mark(edges)) != seen:
        seen = now
        if not now[0]:
            break
        last, edges = edges, B.scratch_table(spark, _round(edges), "edges")
        B.forget(spark, last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
