"""Audit rows and the outcome of batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.sql import Expr
from inkveil.functions.text import details_json, iso_stamp


def _log(df: DataFrame, operation: str, fields: list[str], at: str, user_id: str | None) -> DataFrame:
    """Log rows of ``df`` (with a task_id); ``at`` and ``user_id`` are SQL expressions.

    The id is derived from what is logged, so that a retried task appends the same row.
    """
    body = details_json(**{name: name for name in fields}, timestamp=iso_stamp(Expr(at)).sql)
    rows = df.select(
        F.col("task_id").cast("string").alias("task_id"),
        F.lit(operation).alias("operation_type"),
        F.expr(user_id or "null").cast("string").alias("user_id"),
        body.alias("details"),
        F.expr(at).alias("created_at"),
    )
    id_ = F.sha2(F.concat_ws("|", "task_id", "operation_type", "details"), 256)
    return rows.select(id_.alias("id"), *rows.columns)


def append_upload_log(tasks: DataFrame, at: str = "now()", user_id: str | None = None) -> DataFrame:
    """Upload rows of (task_id, filename, file_size, file_type)."""
    return _log(tasks, "upload", ["filename", "file_size", "file_type"], at, user_id)


def append_desensitization_log(runs: DataFrame, at: str = "now()", user_id: str | None = None) -> DataFrame:
    """Rewriting rows of (task_id, applied_rules, total_items, desensitized_items)."""
    return _log(runs, "desensitization", ["applied_rules", "total_items", "desensitized_items"], at, user_id)


def append_download_log(exports: DataFrame, at: str = "now()", user_id: str | None = None) -> DataFrame:
    """Download rows of (task_id, filename, output_format)."""
    return _log(exports, "download", ["filename", "output_format"], at, user_id)


def batch_summary(outcome: DataFrame) -> DataFrame:
    """Totals of an outcome table (file, error_code, …); ok when nothing failed."""
    return outcome.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("error_code").isNull()).alias("successful_files"),
        F.count_if(F.col("error_code").isNotNull()).alias("failed_files"),
        (F.count_if(F.col("error_code").isNotNull()) == 0).alias("ok"),
    )


# Prefixes of batch error messages by the stage that failed.
ERROR_PREFIXES = {"parse": "Parsing error: ", "recognize": "Recognition error: "}


def batch_errors(outcome: DataFrame) -> DataFrame:
    """(file, error) of the failed files of an outcome table (file, stage, message, error_code)."""
    prefix = F.lit("")
    for stage, text in ERROR_PREFIXES.items():
        prefix = F.when(F.col("stage") == stage, text).otherwise(prefix)
    failed = outcome.where(F.col("error_code").isNotNull())
    return failed.select("file", F.concat(prefix, F.col("message")).alias("error"))
