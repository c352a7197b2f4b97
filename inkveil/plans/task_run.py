"""The stages of a task over whole tables: parse, identify, preview and export.

Every stage takes all tasks, gates them, and returns all tasks with their new status; refused tasks keep
theirs and carry a ``reject_reason``. Requests are tables, so one job serves any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import sql as X
from inkveil.functions.arrays import empty
from inkveil.functions.masking import rewrite_value
from inkveil.functions.spans import EDIT, splice_text
from inkveil.functions.text import export_filename
from inkveil.operators.audit import append_desensitization_log, append_download_log
from inkveil.operators.recognize import explode_items, identify
from inkveil.operators.rules import enabled_rules
from inkveil.operators.tasks import advance_status, stage_gate_identify, stage_gate_parse, stage_gate_render
from inkveil.sources.sinks import export_route


def run_parse(tasks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Tasks after parsing. ``parsed`` has (id, text, error_code) of the files that were read.

    Uploaded tasks become ``parsed`` with their text, or ``failed`` on an error or without a file.
    """
    read = parsed.select(F.col("id").alias("of_id"), "text", F.col("error_code").alias("parse_error"))
    joined = stage_gate_parse(tasks).join(read, F.col("id") == F.col("of_id"), "left")
    let_in = F.col("reject_reason").isNull()
    code = F.when(let_in, F.when(F.col("of_id").isNull(), "FILE_NOT_FOUND").otherwise(F.col("parse_error")))
    return (
        joined.withColumn("error_code", code)
        .withColumn("status", F.when(let_in, advance_status(F.col("error_code"), "parsed")).otherwise(F.col("status")))
        .withColumn("content", F.when(let_in & F.col("error_code").isNull(), F.col("text")).otherwise(F.col("content")))
        .drop("of_id", "text", "parse_error")
    )


def run_identify(tasks: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and items after recognition.

    Parsed tasks with content become ``identified``, and their stored items are replaced by those found,
    also where nothing was found.
    """
    gated = stage_gate_identify(tasks)
    let_in = F.col("reject_reason").isNull()
    found = gated.where(let_in).select(F.col("id").alias("task_id"), identify("content").alias("items"))
    new = explode_items(found, "task_id").select(*items.columns)
    others = items.join(found.select(F.col("task_id").alias("of_id")), F.col("task_id") == F.col("of_id"), "left_anti")
    done = gated.withColumn("status", F.when(let_in, F.lit("identified")).otherwise(F.col("status")))
    return done, others.unionByName(new)


def chosen_rules(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """(task_id, type, rule, strategy): the first enabled rule of each type among those a task asks for.

    ``requests`` has (task_id, rule_id).
    """
    asked = requests.select("task_id", F.col("rule_id").alias("id")).distinct().join(enabled_rules(rules), "id")
    first = F.min(F.struct("created_at", "id", "strategy")).alias("first")
    return asked.groupBy("task_id", F.col("data_type").alias("type")).agg(first).select(
        "task_id", "type", F.col("first.id").alias("rule"), F.col("first.strategy").alias("strategy")
    )


def edits_of(items: DataFrame) -> DataFrame:
    """(task_id, edits, total_items, desensitized_items, applied_rules) of an item table with the columns
    ``rule`` and ``strategy``. The edits of one text are gathered, in the order (start, end, id)."""
    new = rewrite_value("value", "type", "strategy")
    edit = F.struct("start_pos", "end_pos", new.alias("new_value")).cast(EDIT)
    entry = F.when(new.isNotNull(), F.struct("start_pos", "end_pos", "id", edit.alias("edit")))
    return items.groupBy("task_id").agg(
        F.sort_array(F.collect_list(entry)).alias("ordered"),
        F.count(F.lit(1)).alias("total_items"),
        F.count("rule").alias("desensitized_items"),
        F.array_sort(F.collect_set("rule")).alias("applied_rules"),
    )


def _rendered(tasks: DataFrame, items: DataFrame, rules: DataFrame, requests: DataFrame) -> DataFrame:
    chosen = chosen_rules(rules, requests)
    ruled = items.where("start_pos >= 0 and end_pos >= start_pos").join(chosen, ["task_id", "type"], "left")
    made = edits_of(ruled).withColumnRenamed("task_id", "of_id")
    gated = stage_gate_render(tasks).join(made, F.col("id") == F.col("of_id"), "left")
    within = X.filter(X.transform(X.col("ordered"), lambda x: x["edit"]), lambda e: e["start_pos"] <= X.length(X.col("content")))
    edits = X.coalesce(within, empty(EDIT))
    return gated.withColumn("rendered", F.when(F.col("reject_reason").isNull(), splice_text("content", edits.sql))).withColumns(
        {
            "total_items": F.coalesce("total_items", F.lit(0)),
            "desensitized_items": F.coalesce("desensitized_items", F.lit(0)),
            "applied_rules": F.coalesce("applied_rules", F.array().cast("array<string>")),
        }
    )


def run_preview(
    tasks: DataFrame, items: DataFrame, rules: DataFrame, requests: DataFrame, chosen_items: DataFrame | None = None, at: str = "now()"
) -> tuple[DataFrame, DataFrame]:
    """Previews of all tasks that ask for one, and the log rows of those that are not refused.

    ``requests`` has (task_id, rule_id); ``chosen_items`` (task_id, id) narrows the items of the tasks it
    names, the others use all of theirs.
    """
    if chosen_items is not None:
        named = chosen_items.select(F.col("task_id").alias("of_id")).distinct()
        free = items.join(named, F.col("task_id") == F.col("of_id"), "left_anti")
        picked = items.join(chosen_items.select("task_id", "id").distinct(), ["task_id", "id"], "left_semi")
        items = free.unionByName(picked)
    asking = tasks.join(requests.select(F.col("task_id").alias("asking")).distinct(), F.col("id") == F.col("asking"), "left_semi")
    shown = _rendered(asking, items, rules, requests).select(
        F.col("id").alias("task_id"), "reject_reason", F.col("content").alias("original"), F.col("rendered").alias("desensitized"),
        "total_items", "desensitized_items", "applied_rules",
    )
    return shown, append_desensitization_log(shown.where("reject_reason is null"), at)


def run_export(
    tasks: DataFrame, items: DataFrame, rules: DataFrame, requests: DataFrame, output_format: Column, at: str = "now()"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exported texts with their file names, all tasks with their new status, and the log rows.

    ``output_format`` is a column of tasks. An unknown format is refused; a task that is exported becomes
    ``completed``.
    """
    asking = tasks.join(requests.select(F.col("task_id").alias("asking")).distinct(), F.col("id") == F.col("asking"), "left_semi")
    made = _rendered(asking.withColumn("output_format", output_format), items, rules, requests)
    route = export_route(F.col("output_format"))
    refused = F.coalesce("reject_reason", F.when(route == "UNSUPPORTED_FORMAT", route))
    exports = made.select(
        F.col("id").alias("task_id"),
        refused.alias("reject_reason"),
        route.alias("output_format"),
        export_filename("filename", "lower(output_format)", at).alias("filename"),
        F.when(refused.isNull(), F.col("rendered")).alias("content"),
    )
    done = exports.where("reject_reason is null").select(F.col("task_id").alias("done_id"))
    status = F.when(F.col("done_id").isNotNull(), "completed").otherwise(F.col("status"))
    after = tasks.join(done, F.col("id") == F.col("done_id"), "left").withColumn("status", status).drop("done_id")
    return exports, after, append_download_log(exports.where("reject_reason is null"), at)
