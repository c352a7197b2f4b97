"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list[str | Column], array: str | Column, pos: str, name: str) -> DataFrame:
    """``keep`` with one row per element of ``array``, and its index from 0.

    For a plain explode the optimizer adds a filter on the array not being empty, and so
    computes an array expression three times. The outer form has no such filter; the rows
    it adds for empty arrays go by their null index.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.where(F.col(pos).isNotNull())
