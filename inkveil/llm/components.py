"""Connected components by alternating star contractions; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.shared import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select(F.col("u").alias("at"), F.least("u", "low").alias("low"))
    return both.where("v > u").join(low, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = _least(edges)
    moved = edges.join(low.withColumnRenamed("u", "at"), F.col("u") == F.col("at")).where("v > low")
    return moved.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the stored table ``pairs`` (src, dst; src is not dst).

    The root is the smallest node of the component. The number of rounds grows with the logarithm of the
    longest path; only two numbers per round reach the driver.
    """
    edges = pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    mark = None
    while True:
        edges = stored(_small_star(_large_star(edges)).distinct(), "components")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
