"""Overlaps between items resolved in an item table, for documents with any number of items.

``merge_items`` decides the items of a document one after the other, in an array. But items that no other
overlaps, and groups of items that overlap only among themselves, do not affect each other: such an island
begins where an item starts at or after the end of all before it. Islands are cut out by running maxima, and only the
items of one island meet.

Most documents have few items: theirs meet in one shuffle by document, and all further steps stay in that order.
Of a document with more than a block of items, the sorted table is stored, and the maxima go by blocks of rows
and over the blocks' totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.spans import ITEM, merge_items
from inkveil.sources.sinks import shared_folder

#: Rows in a block; a document's blocks are put in order by one task.
BLOCK = 4096
FIELDS = ["start_pos", "end_pos", "type", "value", "confidence"]


def _each(counted: DataFrame, key: str) -> DataFrame:
    """Items counted in ``_n`` as rows: one each, but every copy of an empty span."""
    copies = F.when(F.col("start_pos") == F.col("end_pos"), F.col("_n")).otherwise(F.lit(1)).cast("int")
    return counted.select(key, *FIELDS, F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def in_order(items: DataFrame, key: str) -> DataFrame:
    """``items`` without copies, with ``_place``, their place in the order of key and fields.

    Copies of empty spans stay, as they overlap nothing. The places are stored, so that they stay the same.
    """
    each = _each(items.groupBy(key, *FIELDS).agg(F.count(F.lit(1)).alias("_n")), key)
    order = [F.col(c).asc_nulls_first() for c in (key, *FIELDS)]
    ordered = each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    target = shared_folder(items.sparkSession, "ordered-items")
    ordered.write.parquet(target)
    return items.sparkSession.read.schema(ordered.schema).parquet(target)


def with_islands(ordered: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``ordered`` with ``_island``, the place of the first item of each item's island."""
    rows = ordered.withColumn("_block", F.col("_place") - F.pmod("_place", F.lit(block)))
    within = Window.partitionBy(key, "_block").orderBy("_place")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)

    def carried(df: DataFrame, value, name: str) -> DataFrame:
        """``df`` with the maximum of ``value`` over the key's earlier blocks."""
        totals = df.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(F.max(value).alias("_total"))
        over = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select("_key", "_of", F.max("_total").over(over).alias(name))
        return df.join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")), "left").drop("_key", "_of")

    reached = carried(rows, F.col("end_pos"), "_earlier")
    reach = F.greatest(F.max("end_pos").over(before), F.col("_earlier"))
    begins = reached.withColumn("_reach", reach).withColumn(
        "_first", F.when(F.col("_reach").isNull() | (F.col("start_pos") >= F.col("_reach")), F.col("_place"))
    )
    told = carried(begins, F.col("_first"), "_open")
    island = F.coalesce(F.max("_first").over(upto), F.col("_open"))
    return told.withColumn("_island", island).select(key, *FIELDS, "_place", "_island")


def islands_by_document(items: DataFrame, key: str) -> DataFrame:
    """``items`` without copies, with ``_place`` and ``_island`` in their document, whose items one task orders."""
    ordered = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_first() for c in FIELDS))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    counted = items.select(key, *FIELDS).repartition(key).groupBy(key, *FIELDS).agg(F.count(F.lit(1)).alias("_n"))
    placed = _each(counted, key).select(
        key, *FIELDS, F.row_number().over(ordered).alias("_place"), F.max("end_pos").over(before).alias("_reach")
    )
    begins = F.col("_reach").isNull() | (F.col("start_pos") >= F.col("_reach"))
    return placed.withColumn("_island", F.max(F.when(begins, F.col("_place"))).over(upto)).drop("_reach")


def merge_item_table(items: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, start_pos, end_pos, type, value, confidence): the items that ``merge_items`` keeps of each document.

    No group is larger than an island.
    """
    spark = items.sparkSession
    # one row per ``block`` items at most
    target = shared_folder(spark, "hot-documents")
    counted = items.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    counted.where(F.col("_n") > block).select("_hot").write.parquet(target)
    hot = F.broadcast(spark.read.schema(counted.select("_hot").schema).parquet(target))
    if hot.isEmpty():
        return kept_of(islands_by_document(items, key), key)
    same = F.col(key).eqNullSafe(F.col("_hot"))
    usual = islands_by_document(items.join(hot, same, "left_anti"), key)
    many = with_islands(in_order(items.join(hot, same, "left_semi"), key), key, block)
    return kept_of(usual, key).unionByName(kept_of(many, key))


def kept_of(found: DataFrame, key: str) -> DataFrame:
    """The items that are kept of each island."""
    item = F.struct(*FIELDS).cast(ITEM)
    gathered = found.groupBy(key, "_island").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_place"), item.alias("item")))).alias("_group")
    )
    kept = gathered.withColumn("_kept", merge_items("transform(_group, x -> x.item)"))
    return kept.select(key, F.explode("_kept").alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in FIELDS))
