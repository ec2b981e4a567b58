"""Connected components of an edge table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.session import materialize


def _star(both: DataFrame) -> DataFrame:
    """(u, v) with the least neighbour of u, u itself included, as ``low``."""
    least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
    return both.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return _star(both).filter(F.col("v") > F.col("u")).select(F.col("low").alias("a"), F.col("v").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = _star(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    ends = F.explode(F.array("u", "v"))
    return down.select(F.col("low").alias("a"), ends.alias("b")).filter(F.col("a") < F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a long, b long)``; root is the smallest id that links reach.

    Alternating large-star and small-star rounds; each round is written, so a lost executor costs one round at most. Loops and
    NULL ends are ignored.
    """
    plain = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now, mark = materialize(plain.distinct(), "edges"), None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20)")).alias("h")).first()
        if (sums["n"], sums["h"]) == mark or not sums["n"]:
            break
        mark = (sums["n"], sums["h"])
        now = materialize(_small(_large(now).distinct()).distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select("a", "a").distinct())
