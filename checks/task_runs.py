"""The stages of a task over whole tables."""

from pyspark.sql import functions as F

from checks import duck
from checks.fixtures import fx
from checks.registry import check
from inkveil.plans import task_run

_AT = "timestamp'2024-05-06 07:08:09'"


def _parsed(tasks):
    return tasks.where("cast(id as bigint) % 3 <> 2").selectExpr(
        "id", "concat('text of ', id) as text", "if(cast(id as bigint) % 10 = 0, 'EMPTY_DOCUMENT', null) as error_code"
    )


@check(
    "run_parse",
    "tasks",
    """, o as (select *, case when status <> 'uploaded' then 'NOT_UPLOADED' end as reject_reason,
            case when status = 'uploaded' then case when id::bigint % 3 = 2 then 'FILE_NOT_FOUND' when id::bigint % 10 = 0 then 'EMPTY_DOCUMENT' end end as error_code
        from tasks)
    select id, reject_reason, error_code, case when reject_reason is not null then status when error_code is null then 'parsed' else 'failed' end as status,
        case when reject_reason is null and error_code is null then 'text of ' || id else content end as content from o""",
)
def run_parse(spark, sf_dir):
    tasks = fx(spark, sf_dir, "tasks")
    return task_run.run_parse(tasks, _parsed(tasks)).select("id", "reject_reason", "error_code", "status", "content")


@check(
    "run_identify",
    "tasks items",
    f""", t as (select * replace (case when content <> '' then content || ' 138' || lpad(id, 8, '0') || ' u@b' || id || '.com' else content end as content) from tasks),
    gated as (select id as task_id, content from t where status = 'parsed' and content <> ''), {duck.structured('gated', 'task_id', 'content')},
    after as (select task_id, type, value, start_pos::bigint as start_pos, end_pos::bigint as end_pos from items where task_id not in (select task_id from gated)
        union all select task_id, type, value, s, e from structured)
    select t.id as task_id, case when g.task_id is not null then 'identified' else status end as status, type, value, start_pos, end_pos
    from t left join gated g on g.task_id = t.id left join after a on a.task_id = t.id""",
)
def run_identify(spark, sf_dir):
    longer = F.expr("if(content <> '', concat(content, ' 138', lpad(id, 8, '0'), ' u@b', id, '.com'), content)")
    tasks = fx(spark, sf_dir, "tasks").withColumn("content", longer)
    done, items = task_run.run_identify(tasks, fx(spark, sf_dir, "items"))
    spans = items.select(
        F.col("task_id").alias("of_id"), "type", "value", F.col("start_pos").cast("bigint"), F.col("end_pos").cast("bigint")
    )
    return done.select(F.col("id").alias("task_id"), "status").join(spans, F.col("task_id") == F.col("of_id"), "left").drop("of_id")


def _requests(tasks):
    """Every task asks for six rules, some of them disabled, of one type, or without a strategy."""
    six = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")
    return tasks.select(F.col("id").alias("task_id"), six).selectExpr("task_id", "concat('r', 1 + cast(task_id as bigint) % 5 + j) as rule_id")


_RENDERED = f""", requests as (select id as task_id, 'r' || (1 + id::bigint % 5 + j) as rule_id from tasks, (select unnest([0, 1, 2, 3, 4, 5]) as j)),
    chosen as (select task_id, data_type as type, rules.id as rule, strategy from requests join rules on rules.id = rule_id where enabled
        qualify row_number() over (partition by task_id, data_type order by created_at, rules.id) = 1),
    ruled as (select i.*, rule, strategy from used i left join chosen c on c.task_id = i.task_id and c.type = i.type
        where start_pos >= 0 and end_pos >= start_pos),
    stats as (select task_id, count(*) as n, count(rule) as d, string_agg(distinct rule, ',' order by rule) as a from ruled group by task_id),
    every as (select r.task_id, t.content as text, start_pos as s, end_pos as e, {duck.rewrite('value', 'type', 'strategy')} as nv, (end_pos, r.id) as ord
        from ruled r join tasks t on t.id = r.task_id where t.content <> '' and start_pos <= length(t.content)),
    edits as (select * from every where nv is not null), {duck.sequential('edits', 'done', 'task_id')},
    rendered as (select t.*, case when coalesce(content, '') = '' then 'NO_CONTENT' end as reject_reason,
            case when content <> '' then coalesce(deid_text, content) end as desensitized, coalesce(n, 0) as total_items,
            coalesce(d, 0) as desensitized_items, coalesce(a, '') as applied_rules
        from tasks t left join done on done.task_id = t.id left join stats on stats.task_id = t.id)"""


@check(
    "run_preview",
    "tasks items rules",
    f""", used as (select * from items where task_id::bigint % 4 <> 1 or type in ('phone', 'email')) {_RENDERED}
    select id as task_id, reject_reason, content as original, desensitized, total_items, desensitized_items, applied_rules,
        reject_reason is null as logged from rendered""",
)
def run_preview(spark, sf_dir):
    """A quarter of the tasks choose their items as well."""
    tasks, items = fx(spark, sf_dir, "tasks"), fx(spark, sf_dir, "items")
    some = items.where("cast(task_id as bigint) % 4 = 1")
    # a task that chooses names at least one id, known or not
    picked = some.select("task_id", F.when(F.col("type").isin("phone", "email"), F.col("id")).otherwise("none").alias("id"))
    shown, log = task_run.run_preview(tasks, items, fx(spark, sf_dir, "rules"), _requests(tasks), picked, _AT)
    logged = log.select(F.col("task_id").alias("of_id"), F.lit(True).alias("logged"))
    joined = shown.join(logged, F.col("task_id") == F.col("of_id"), "left").drop("of_id")
    return joined.withColumns({"logged": F.coalesce("logged", F.lit(False)), "applied_rules": F.array_join("applied_rules", ",")})


@check(
    "run_export",
    "tasks items rules",
    f""", used as (select * from items) {_RENDERED},
    e as (select *, coalesce(reject_reason, case when file_type not in ('txt', 'md', 'docx', 'xlsx') then 'UNSUPPORTED_FORMAT' end) as refused from rendered)
    select id as task_id, refused as reject_reason, case when refused is null then desensitized end as content,
        regexp_replace(filename, '\\.[^.]*$', '') || '_desensitized_20240506_070809.' || file_type as filename,
        case when refused is null then 'completed' else status end as status, case when refused is null then file_type end as logged from e""",
)
def run_export(spark, sf_dir):
    tasks = fx(spark, sf_dir, "tasks")
    exports, after, log = task_run.run_export(
        tasks, fx(spark, sf_dir, "items"), fx(spark, sf_dir, "rules"), _requests(tasks), F.upper("file_type"), _AT
    )
    status = after.select(F.col("id").alias("of_id"), "status")
    logged = log.select(F.col("task_id").alias("log_id"), F.get_json_object("details", "$.output_format").alias("logged"))
    joined = exports.join(status, F.col("task_id") == F.col("of_id")).join(logged, F.col("task_id") == F.col("log_id"), "left")
    return joined.select("task_id", "reject_reason", "content", "filename", "status", "logged")
