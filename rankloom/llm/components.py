"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    linked = down.join(low, "a").where(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """a, b: every linked node that isn't its component's least, and that least node.

    ``edges``: a, b (any order; loops and repeats are harmless). Rounds end when the table stays the same;
    every round is a table in the shared folder, so a lost executor costs one round at most.
    """
    now = scratch.table(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        k += 1
        now = scratch.table(_small_star(_large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state
