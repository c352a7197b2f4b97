"""Joins left to adaptive execution, and one that spreads hot keys by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, so there are at most
#: 1 / HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 0.001

#: Parts a hot key is split into.
SALTS = 64


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys holding more than ``HOT_SHARE`` of the rows; at most 1 / HOT_SHARE of them."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col("count") > total * HOT_SHARE).select(key, F.lit(True).alias("_hot"))


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str, spread: Column) -> DataFrame:
    """Equi-join on ``key`` with hot keys of ``big`` split into ``SALTS`` parts.

    Rows of ``small`` are repeated for hot keys only. ``spread`` is a column of ``big`` that
    varies within a key, such as its id; it picks the part, so a retried task picks the same.
    """
    hot = F.broadcast(hot_keys(big, key))
    left = big.withColumn("_spread", F.xxhash64(spread)).join(hot, key, "left")
    left = left.withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod("_spread", F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    )
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.drop("_spread", "_hot").join(right, [key, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str, spread: Column | None = None) -> DataFrame:
    """Join with a side that is usually small.

    Adaptive execution broadcasts it by its size at run time and splits skewed partitions otherwise, so no
    job runs while the plan is built. With ``spread`` hot keys are split in the plan, as ``skew_join`` does.
    """
    return big.join(small, key, how) if spread is None else skew_join(big, small, key, how, spread)
