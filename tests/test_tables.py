"""Stored tables by task, SQL functions of strategies, and recognisers as table functions."""

import os

import pytest
from pyspark.sql import functions as F

from inkveil.functions import masking
from inkveil.functions import sql as X
from inkveil.operators import recognizers, rewrite, tasks
from inkveil.sources import tables


def files_of(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_refresh_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "items")
    items = spark.range(3000).selectExpr("id", "concat('t', id % 100) as task_id", "'a' as type")
    tables.write_by_task(items, path, buckets=64)
    before = files_of(path)
    new = spark.sql("select bigint(-1) as id, 't1' as task_id, 'b' as type union all select -2, 't7', 'b' union all select -3, null, 'b'")
    gone = spark.sql("select 't1' as task_id union all select 't7' union all select 't9' union all select 'unknown' union all select null")
    for _ in range(2):
        tables.refresh_by_task(spark, path, new, gone, buckets=64)
        rows = {(r["id"], r["task_id"]) for r in tables.read_by_task(spark, path).collect()}
        assert rows == {(i, f"t{i % 100}") for i in range(3000) if i % 100 not in (1, 7, 9)} | {(-1, "t1"), (-2, "t7"), (-3, None)}
    touched = {r[0] for r in gone.select(tables.bucket_of("task_id", 64)).collect()}
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept <= files_of(path) and len(kept) > len(before) / 2


def test_a_bucket_without_rows_goes(spark, tmp_path):
    path = str(tmp_path / "items")
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, task_id string")
    tables.write_by_task(items, path, buckets=1000)
    tables.refresh_by_task(spark, path, items.where("false"), items.where("id = 1").select("task_id"), buckets=1000)
    assert [r["id"] for r in tables.read_by_task(spark, path).collect()] == [2]
    tables.refresh_by_task(spark, path, items.where("false"), buckets=1000)
    assert tables.read_by_task(spark, path, "id long, task_id string").count() == 1


def test_new_rows_may_come_from_the_table_itself(spark, tmp_path):
    path = str(tmp_path / "items")
    tables.write_by_task(spark.range(100).selectExpr("id", "concat('t', id % 10) as task_id"), path, buckets=8)
    new = tables.read_by_task(spark, path).where("task_id = 't3'").withColumn("id", F.col("id") + 1000)
    tables.refresh_by_task(spark, path, new, buckets=8)
    found = [r["id"] for r in tables.read_by_task(spark, path).collect()]
    assert sorted(found) == sorted([i if i % 10 != 3 else i + 1000 for i in range(100)])


def test_a_refresh_shuffles_stored_rows_once(spark):
    """However many tasks are refreshed: no join moves the rows before they go to their buckets."""
    rows = spark.range(1000).selectExpr("id", "concat('t', id % 100) as task_id", "int(id % 4) as bucket")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for names in (None, rows.where("id < 10").select("task_id", "bucket")):
            after = tables.refreshed(rows, rows.where("id >= 990"), names, "task_id")
            plan = after._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Join" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_new_rows_of_tasks_not_named_are_added(spark, tmp_path):
    path = str(tmp_path / "items")
    tables.write_by_task(spark.range(100).selectExpr("id", "concat('t', id % 10) as task_id"), path, buckets=8)
    new = spark.sql("select bigint(-1) as id, 't4' as task_id")
    tables.refresh_by_task(spark, path, new, spark.sql("select 't3' as task_id"), buckets=8)
    found = [r["id"] for r in tables.read_by_task(spark, path).collect()]
    assert sorted(found) == [-1, *(i for i in range(100) if i % 10 != 3)]


def test_bucketed_join_shuffles_nothing(spark, tmp_path):
    task_rows = spark.range(500).selectExpr("concat('t', id) as id", "'f' as filename", "'parsed' as status")
    items = spark.range(4000).selectExpr("id", "concat('t', id % 700) as task_id")
    left = tables.save_bucketed(task_rows, "test_tasks", str(tmp_path / "tasks"), "id", 8)
    right = tables.save_bucketed(items, "test_items", str(tmp_path / "items"), "task_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tasks.task_items_join(left, right)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == items.where("id % 700 < 500").count()
        split = tasks.task_items_join(task_rows, items, spread=F.col("id"))
        assert split.count() == joined.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table test_tasks")
        spark.sql("drop table test_items")


def test_a_subset_runs_no_job_while_it_is_planned(spark):
    items = spark.range(10).selectExpr("cast(id as string) as id", "id as v")
    ids = spark.createDataFrame([("3",), ("3",), ("x",)], "id string")
    assert [r["v"] for r in rewrite.items_subset(items, ids).collect()] == [3]
    assert rewrite.items_subset(items, ids.where("false")).count() == rewrite.items_subset(items, None).count() == 10


def test_strategies_in_sql(spark):
    masking.register_strategy("tail", lambda value, type_: X.concat("*", X.right(value, 2)))
    try:
        made = masking.register_functions(spark, "t_")
        assert {"t_mask", "t_replace", "t_delete", "t_tail", "t_rewrite"} <= set(made)
    finally:
        del masking.STRATEGIES["tail"]
    row = spark.sql(
        "select t_tail(v, 'x') as tail, t_mask(v, 'phone') as mask, t_rewrite(v, 'phone', 'delete') as gone, t_rewrite(v, 'phone', 'none') as none,"
        " t_mask(null, 'phone') as nothing from values ('13812345678') as t(v)"
    )
    assert tuple(row.first()) == ("*78", "138****5678", "", None, None)
    assert "Python" not in row._jdf.queryExecution().executedPlan().toString()
    masking.register_strategy("not a name", masking.delete_value)
    try:
        with pytest.raises(ValueError):
            masking.register_functions(spark, "t_")
    finally:
        del masking.STRATEGIES["not a name"]


def test_recogniser_as_a_table_function(spark):
    def people(text):
        if "bad" in text:
            raise RuntimeError("cannot read this")
        if "beyond" in text:
            return [(0, len(text) + 1, "PERSON")]
        return [(i, i + 3, "PERSON") for i in range(len(text)) if text.startswith("Ann", i)] + [(0, 0, "TEAM")]

    texts = [(1, "Ann and Ann"), (2, "bad"), (3, ""), (4, None), (5, "beyond"), (6, "😀Ann")]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    found, errors = recognizers.annotate(docs, people)
    spans = {(r.doc_id, r.label, r.start_pos, r.end_pos, r.value) for r in found.collect()}
    assert spans == {(1, "PERSON", 0, 3, "Ann"), (1, "PERSON", 8, 11, "Ann"), (6, "PERSON", 1, 4, "Ann")} | {(i, "TEAM", 0, 0, "") for i in (1, 3, 6)}
    assert {r.doc_id: r.error for r in errors.collect()} == {
        2: "RuntimeError: cannot read this", 5: "ValueError: span 0 to 7 is not within the text"
    }
    column = docs.select("doc_id", recognizers.recognized(F.col("text"), people).alias("r")).select("doc_id", "r.*")
    rows = {r.doc_id: r for r in column.collect()}
    assert [x["value"] for x in rows[1]["items"]] == ["Ann", "Ann"] and rows[2]["items"] is None and rows[4]["items"] == []
    assert rows[5]["error"].startswith("ValueError")


def test_a_local_folder_is_no_shared_one():
    from types import SimpleNamespace

    from inkveil.sources.sinks import shared_root

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, *default: conf.get(name.split(".")[-2], *default)), sparkContext=SimpleNamespace(master=master))

    assert shared_root(session("local[8]", warehouse="/w/")) == "/w"
    assert shared_root(session("yarn", warehouse="hdfs://n/w")) == "hdfs://n/w"
    assert shared_root(session("yarn", warehouse="/w", checkpoint="/mnt/all")) == "/mnt/all"
    for local in ("/w", "file:/w"):
        with pytest.raises(ValueError):
            shared_root(session("spark://a:7077", warehouse=local))
