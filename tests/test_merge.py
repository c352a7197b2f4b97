"""Overlaps resolved in a table, against the merge of arrays."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions import spans
from inkveil.operators import merge
from inkveil.operators.recognize import entity_items

FIELDS = "doc_id int, start_pos int, end_pos int, type string, value string, confidence double"


def by_arrays(items):
    grouped = entity_items(items, "doc_id").select("doc_id", spans.merge_items("entities").alias("m"))
    return grouped.select("doc_id", F.explode("m").alias("x")).select("doc_id", "x.*")


def random_rows(count, docs, wide, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        start = rng.randint(0, wide)
        rows.append((rng.choice(docs), start, start + rng.choice([0, 0, 1, 2, 5, 30]), rng.choice("ab"), None if rng.random() < 0.1 else "v", rng.choice([0.5, 0.8, 1.0])))
    return rows + rng.sample(rows, count // 10)


@pytest.mark.parametrize("block", [1, 7, 4096])
@pytest.mark.parametrize("wide", [40, 4000])
def test_table_equals_arrays(spark, block, wide):
    items = spark.createDataFrame(random_rows(1500, [1, 1, 1, 2, 3, None], wide, wide), FIELDS).repartition(5)
    made, wanted = merge.merge_item_table(items, block=block), by_arrays(items)
    # the arrays have no null document
    made = made.where("doc_id is not null").select(wanted.columns)
    wanted = wanted.where("doc_id is not null")
    assert made.exceptAll(wanted).isEmpty() and wanted.exceptAll(made).isEmpty() and not made.isEmpty()


def test_one_document_with_very_many_items(spark):
    """No task gathers more than an island."""
    n = 400_000
    one = spark.range(n).selectExpr(
        "1 as doc_id", "cast(id * 3 as int) as start_pos", "cast(id * 3 + if(id % 4 = 0, 5, 2) as int) as end_pos", "'a' as type",
        "'v' as value", "if(id % 4 = 0, 0.5D, 0.8D) as confidence",
    )
    islands = merge.with_islands(merge.in_order(one, "doc_id"), "doc_id", block=1000)
    sizes = islands.groupBy("_island").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(sizes) == (2, n * 3 // 4)
    kept = merge.merge_item_table(one)
    # of each pair that overlaps, the second one is more certain
    assert kept.count() == n * 3 // 4 and kept.where("confidence = 0.5").isEmpty()


def test_empty_table(spark):
    assert merge.merge_item_table(spark.createDataFrame([], FIELDS)).count() == 0


def test_usual_documents_are_shuffled_once(spark):
    """But for the count, no step after the first one moves the items again."""
    items = spark.createDataFrame(random_rows(500, list(range(50)), 200, 1), FIELDS)
    plan = merge.merge_item_table(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_usual_and_hot_documents_together(spark):
    rows = random_rows(600, [1], 300, 5) + random_rows(600, list(range(2, 60)), 50, 6)
    items = spark.createDataFrame(rows, FIELDS).repartition(4)
    made, wanted = merge.merge_item_table(items, block=100), by_arrays(items)
    assert made.select("doc_id").distinct().count() == 59
    made = made.select(wanted.columns)
    assert made.exceptAll(wanted).isEmpty() and wanted.exceptAll(made).isEmpty()
