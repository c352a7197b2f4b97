"""Tasks, items and logs as tables: gates, status, projections, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.joins import lookup_join
from inkveil.schemas import DOMAINS


def task_by_id(tasks: DataFrame, task_id) -> DataFrame:
    return tasks.where(F.col("id") == task_id).limit(1)


def items_of_task(items: DataFrame, task_id) -> DataFrame:
    return items.where(F.col("task_id") == task_id)


def project_task(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", "filename", "file_size", "file_type", "upload_time", "status")


def project_item(items: DataFrame) -> DataFrame:
    return items.select("id", "type", "value", "start_pos", "end_pos", "confidence")


def project_rule(rules: DataFrame) -> DataFrame:
    return rules.select("id", "name", "data_type", "strategy", "is_system", "enabled")


def _has_content() -> Column:
    return F.coalesce(F.col("content"), F.lit("")) != ""


def stage_gate_parse(tasks: DataFrame) -> DataFrame:
    """All tasks with ``reject_reason``: only uploaded ones may be parsed."""
    return tasks.withColumn("reject_reason", F.when(F.col("status") != "uploaded", "NOT_UPLOADED"))


def stage_gate_identify(tasks: DataFrame) -> DataFrame:
    """All tasks with ``reject_reason``: only parsed ones with content may be identified."""
    reason = F.when(F.col("status") != "parsed", "NOT_PARSED").when(~_has_content(), "NO_CONTENT")
    return tasks.withColumn("reject_reason", reason)


def stage_gate_render(tasks: DataFrame) -> DataFrame:
    """All tasks with ``reject_reason``: preview and export need content, whatever the status."""
    return tasks.withColumn("reject_reason", F.when(~_has_content(), "NO_CONTENT"))


def advance_status(error_code: Column, next_status: str | Column) -> Column:
    """The next status, or ``failed`` on an error."""
    following = F.lit(next_status) if isinstance(next_status, str) else next_status
    return F.when(error_code.isNull(), following).otherwise("failed")


def domain_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``bad_domain``: the first of the columns with a value outside its domain."""
    bad = F.lit(None).cast("string")
    for name in reversed(columns):
        bad = F.when(~F.coalesce(F.col(name).isin(DOMAINS[name]), F.lit(False)), name).otherwise(bad)
    return df.withColumn("bad_domain", bad)


def span_valid(items: DataFrame) -> DataFrame:
    return items.where("end_pos >= start_pos")


def task_items_join(tasks: DataFrame, items: DataFrame, spread: Column | None = None) -> DataFrame:
    """Items with the name and status of their task; only these columns of tasks move.

    Tables of ``save_bucketed`` are joined where they are. Where single tasks have a great part of the items, a
    column of items as ``spread`` splits them.
    """
    narrow = tasks.select(F.col("id").alias("task_id"), "filename", "status")
    return lookup_join(items, narrow, "task_id", "inner", spread)


def items_cascade(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Items whose task still exists."""
    return lookup_join(items, tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi")


def logs_set_null(logs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Logs, with a null task_id where the task is gone."""
    alive = tasks.select(F.col("id").alias("task_id"), F.lit(True).alias("_alive"))
    joined = lookup_join(logs, alive, "task_id", "left")
    return joined.withColumn("task_id", F.when(F.col("_alive"), F.col("task_id"))).drop("_alive").select(logs.columns)


def refresh_items(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Item table with all items of the tasks in ``new`` replaced; repeating it changes nothing.

    This is the table as a query; ``sources.tables.refresh_by_task`` replaces them in a stored one.
    """
    touched = new.select("task_id").distinct()
    return lookup_join(existing, touched, "task_id", "left_anti").unionByName(new)


def logs_by_task(logs: DataFrame, task_id) -> DataFrame:
    """Logs of a task, oldest first."""
    return logs.where(F.col("task_id") == task_id).orderBy("created_at", "id")


def logs_by_operation(logs: DataFrame, operation: str) -> DataFrame:
    """Logs of an operation, newest first."""
    return logs.where(F.col("operation_type") == operation).orderBy(F.desc("created_at"), "id")


def recent_exports(logs: DataFrame, n: int = 5) -> DataFrame:
    """The newest downloads."""
    return logs_by_operation(logs, "download").limit(n)
