"""Tasks, items and logs: scans, gates, upkeep, audit rows."""

from pyspark.sql import functions as F

from checks import duck
from checks.fixtures import fx, given
from checks.registry import check
from inkveil.functions import text as T
from inkveil.operators import audit, rewrite, tasks
from inkveil.sources import sinks, tables


def _tasks(spark, sf_dir):
    return fx(spark, sf_dir, "tasks")


def _items(spark, sf_dir):
    return fx(spark, sf_dir, "items")


def _logs(spark, sf_dir):
    return fx(spark, sf_dir, "logs")


def _positions(df):
    return df.withColumn("start_pos", F.col("start_pos").cast("bigint")).withColumn("end_pos", F.col("end_pos").cast("bigint"))


def _time(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


_TIME = "strftime({x}, '%Y-%m-%d %H:%M:%S.%f') as {x}"


# --- scans and projections --------------------------------------------------------------


@check("scan_tasks", "tasks", "select id, filename, file_type, status from tasks")
def scan_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir).select("id", "filename", "file_type", "status")


@check("scan_items", "items", "select id, task_id, type, value from items")
def scan_items(spark, sf_dir):
    return _items(spark, sf_dir).select("id", "task_id", "type", "value")


@check("scan_logs", "logs", f"select id, task_id, operation_type, {_TIME.format(x='created_at')} from logs")
def scan_logs(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", "task_id", "operation_type", _time("created_at"))


@check("task_by_id", "tasks", "select id, filename, status, content from tasks where id = '77'")
def task_by_id(spark, sf_dir):
    return tasks.task_by_id(_tasks(spark, sf_dir), "77").select("id", "filename", "status", "content")


@check("items_of_task", "items", "select id, type, value from items where task_id = '77'")
def items_of_task(spark, sf_dir):
    return tasks.items_of_task(_items(spark, sf_dir), "77").select("id", "type", "value")


@check(
    "items_subset",
    "items",
    """select 'chosen' as choice, id, type from items where id in (select id from items where type = 'email')
    union all select 'empty', id, type from items union all select 'null', id, type from items""",
)
def items_subset(spark, sf_dir):
    """A list of ids, an empty list and no list; the latter two mean all items."""
    items = _items(spark, sf_dir)
    chosen = items.where("type = 'email'").select("id")
    parts = [
        rewrite.items_subset(items, ids).select(F.lit(name).alias("choice"), "id", "type")
        for name, ids in (("chosen", chosen), ("empty", chosen.where("id is null")), ("null", None))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("project_task", "tasks", f"select id, filename, file_size, file_type, {_TIME.format(x='upload_time')}, status from tasks")
def project_task(spark, sf_dir):
    return tasks.project_task(_tasks(spark, sf_dir)).withColumn("upload_time", _time("upload_time"))


@check(
    "project_item",
    "items",
    "select id, type, value, start_pos::bigint as start_pos, end_pos::bigint as end_pos, confidence from items",
)
def project_item(spark, sf_dir):
    return _positions(tasks.project_item(_items(spark, sf_dir)))


# --- gates and checks -------------------------------------------------------------------


@check(
    "stage_gate_parse", "tasks", "select id, case when status <> 'uploaded' then 'NOT_UPLOADED' end as reject_reason from tasks"
)
def stage_gate_parse(spark, sf_dir):
    return tasks.stage_gate_parse(_tasks(spark, sf_dir)).select("id", "reject_reason")


@check(
    "stage_gate_identify",
    "tasks",
    """select id, case when status <> 'parsed' then 'NOT_PARSED' when content is null or content = '' then 'NO_CONTENT' end as reject_reason
    from tasks""",
)
def stage_gate_identify(spark, sf_dir):
    return tasks.stage_gate_identify(_tasks(spark, sf_dir)).select("id", "reject_reason")


@check(
    "stage_gate_render",
    "tasks",
    "select id, case when content is null or content = '' then 'NO_CONTENT' end as reject_reason from tasks",
)
def stage_gate_render(spark, sf_dir):
    return tasks.stage_gate_render(_tasks(spark, sf_dir)).select("id", "reject_reason")


@check(
    "advance_status",
    "tasks",
    """select id, case when status = 'failed' then 'failed' when status = 'uploaded' and content is null then 'failed'
        when status = 'uploaded' then 'parsed' when status = 'parsed' then 'identified' else 'completed' end as status from tasks""",
)
def advance_status(spark, sf_dir):
    error = F.when(F.col("status") == "failed", "FAILED_BEFORE").when(
        (F.col("status") == "uploaded") & F.col("content").isNull(), "NO_CONTENT"
    )
    following = F.when(F.col("status") == "uploaded", "parsed").when(F.col("status") == "parsed", "identified").otherwise("completed")
    return _tasks(spark, sf_dir).select("id", tasks.advance_status(error, following).alias("status"))


@check(
    "domain_check",
    "tasks items rules",
    """select 'task' as what, id, case when file_type not in ('pdf', 'docx', 'xlsx', 'txt', 'md') then 'file_type' end as bad_domain from tasks
    union all select 'item', id, case when type not in ('name', 'id_card', 'phone', 'address', 'bank_card', 'email') then 'type' end from items
    union all select 'rule', id, case when data_type = 'passport' then 'data_type' when strategy = 'shuffle' then 'strategy' end from rules""",
)
def domain_check(spark, sf_dir):
    checked = [
        ("task", _tasks(spark, sf_dir), ["file_type", "status"]),
        ("item", _items(spark, sf_dir), ["type"]),
        ("rule", fx(spark, sf_dir, "rules"), ["data_type", "strategy"]),
    ]
    parts = [tasks.domain_check(df, columns).select(F.lit(name).alias("what"), "id", "bad_domain") for name, df, columns in checked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("span_valid", "items", "select id, start_pos::bigint as start_pos, end_pos::bigint as end_pos from items where end_pos >= start_pos")
def span_valid(spark, sf_dir):
    return _positions(tasks.span_valid(_items(spark, sf_dir)).select("id", "start_pos", "end_pos"))


# --- joins and upkeep -------------------------------------------------------------------


@check(
    "task_items_join",
    "tasks items",
    "select items.id, task_id, type, filename, status from items join tasks on tasks.id = task_id",
)
def task_items_join(spark, sf_dir):
    return tasks.task_items_join(_tasks(spark, sf_dir), _items(spark, sf_dir)).select("id", "task_id", "type", "filename", "status")


@check(
    "items_cascade",
    "tasks items",
    "select id, task_id from items where task_id in (select id from tasks where status <> 'failed')",
)
def items_cascade(spark, sf_dir):
    alive = _tasks(spark, sf_dir).where("status <> 'failed'")
    return tasks.items_cascade(_items(spark, sf_dir), alive).select("id", "task_id")


@check(
    "logs_set_null",
    "tasks logs",
    """select id, case when task_id in (select id from tasks where status <> 'failed') then task_id end as task_id, operation_type
    from logs""",
)
def logs_set_null(spark, sf_dir):
    alive = _tasks(spark, sf_dir).where("status <> 'failed'")
    return tasks.logs_set_null(_logs(spark, sf_dir), alive).select("id", "task_id", "operation_type")


@check(
    "refresh_items",
    "items",
    """, fresh as (select id || '-new' as id, task_id, type, value, start_pos, end_pos, confidence from items
        where type in ('email', 'address') and confidence = 1.0)
    select id, task_id, type from items where task_id not in (select task_id from fresh)
    union all select id, task_id, type from fresh""",
)
def refresh_items(spark, sf_dir):
    """Refreshed twice with the same batch, since a repetition must change nothing."""
    items = _items(spark, sf_dir)
    batch = items.where("type in ('email', 'address') and confidence = 1.0").withColumn("id", F.concat("id", F.lit("-new")))
    return tasks.refresh_items(tasks.refresh_items(items, batch), batch).select("id", "task_id", "type")


_FRESH = """, fresh as (select id || '-new' as id, task_id, type, value, start_pos, end_pos, confidence from items
        where type in ('email', 'address') and confidence = 1.0), gone as (select task_id from fresh union select task_id from items where type = 'passport')"""


@check(
    "refresh_items_in_place",
    "items",
    f"""{_FRESH} select id, task_id, type from items where task_id not in (select task_id from gone)
    union all select id, task_id, type from fresh""",
)
def refresh_items_in_place(spark, sf_dir):
    """A stored table refreshed twice with the same batch; some tasks are left without items."""
    path = sinks.shared_folder(spark, "items")
    items = _items(spark, sf_dir)
    tables.write_by_task(items, path, buckets=64)
    stored = tables.read_by_task(spark, path)
    batch = stored.where("type in ('email', 'address') and confidence = 1.0").withColumn("id", F.concat("id", F.lit("-new")))
    named = batch.select("task_id").unionByName(stored.where("type = 'passport'").select("task_id"))
    fixed = sinks.shared_folder(spark, "batch")
    batch.write.parquet(f"{fixed}/rows")
    named.distinct().write.parquet(f"{fixed}/tasks")
    for _ in range(2):
        tables.refresh_by_task(spark, path, spark.read.parquet(f"{fixed}/rows"), spark.read.parquet(f"{fixed}/tasks"), buckets=64)
    return tables.read_by_task(spark, path).select("id", "task_id", "type")


@check(
    "task_items_bucketed",
    "tasks items",
    "select items.id, task_id, type, filename, status from items join tasks on tasks.id = task_id",
)
def task_items_bucketed(spark, sf_dir):
    """Both tables stored in the same buckets; the join shuffles neither."""
    folder = sinks.shared_folder(spark, "bucketed")
    name = folder.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = tables.save_bucketed(_tasks(spark, sf_dir), f"tasks_{name}", f"{folder}/tasks", "id", buckets)
    right = tables.save_bucketed(_items(spark, sf_dir), f"items_{name}", f"{folder}/items", "task_id", buckets)
    return tasks.task_items_join(left, right).select("id", "task_id", "type", "filename", "status")


# --- logs -------------------------------------------------------------------------------


@check(
    "logs_by_task",
    "logs",
    f"select id, operation_type, {_TIME.format(x='created_at')} from logs where task_id = '8' order by created_at, id",
)
def logs_by_task(spark, sf_dir):
    return tasks.logs_by_task(_logs(spark, sf_dir), "8").select("id", "operation_type", _time("created_at"))


@check(
    "logs_by_operation",
    "logs",
    f"select id, task_id, {_TIME.format(x='created_at')} from logs where operation_type = 'upload' order by created_at desc, id",
)
def logs_by_operation(spark, sf_dir):
    return tasks.logs_by_operation(_logs(spark, sf_dir), "upload").select("id", "task_id", _time("created_at"))


@check(
    "recent_exports",
    "logs",
    f"""select id, task_id, {_TIME.format(x='created_at')} from (select * from logs where operation_type = 'download'
    order by created_at desc, id limit 5)""",
)
def recent_exports(spark, sf_dir):
    return tasks.recent_exports(_logs(spark, sf_dir)).select("id", "task_id", _time("created_at"))


@check(
    "details_get",
    "logs",
    """select id, details->>'$.filename' as filename, details->>'$.output_format' as output_format, details->>'$.absent' as absent
    from logs""",
)
def details_get(spark, sf_dir):
    names = ("filename", "output_format", "absent")
    return _logs(spark, sf_dir).select("id", *[T.details_get("details", n).alias(n) for n in names])


@check(
    "details_json",
    "tasks",
    """select id, '{"filename":"' || filename || '","file_size":' || file_size || ',"file_type":"' || file_type || '"}' as details from tasks""",
)
def details_json(spark, sf_dir):
    fields = {name: name for name in ("filename", "file_size", "file_type")}
    return _tasks(spark, sf_dir).select("id", T.details_json(**fields).alias("details"))


_AT = "timestamp'2024-05-06 07:08:09.123456'"
_ISO = '"2024-05-06T07:08:09.123456"'


def _audited(df):
    return df.select("task_id", "operation_type", "user_id", "details", _time("created_at"))


@check(
    "append_upload_log",
    "tasks",
    f"""select id as task_id, 'upload' as operation_type, 'u1' as user_id, '{{"filename":"' || filename || '","file_size":' || file_size
        || ',"file_type":"' || file_type || '","timestamp":{_ISO}}}' as details, '2024-05-06 07:08:09.123456' as created_at from tasks""",
)
def append_upload_log(spark, sf_dir):
    return _audited(audit.append_upload_log(_tasks(spark, sf_dir).withColumnRenamed("id", "task_id"), _AT, "'u1'"))


@check(
    "append_desensitization_log",
    "items rules",
    f""", {duck.FIRST_RULE}
    select task_id, 'desensitization' as operation_type, null as user_id, '{{"applied_rules":['
        || coalesce(string_agg(distinct '"' || first_rule.id || '"', ',' order by '"' || first_rule.id || '"'), '') || '],"total_items":' || count(*)
        || ',"desensitized_items":' || count(first_rule.id) || ',"timestamp":{_ISO}}}' as details, '2024-05-06 07:08:09.123456' as created_at
    from items left join first_rule on data_type = type group by task_id""",
)
def append_desensitization_log(spark, sf_dir):
    runs = rewrite.preview_statistics(_items(spark, sf_dir), fx(spark, sf_dir, "rules"))
    return _audited(audit.append_desensitization_log(runs, _AT))


@check(
    "append_download_log",
    "tasks",
    f"""select id as task_id, 'download' as operation_type, null as user_id, '{{"filename":"' || filename || '","output_format":"md","timestamp":{_ISO}}}'
        as details, '2024-05-06 07:08:09.123456' as created_at from tasks""",
)
def append_download_log(spark, sf_dir):
    done = _tasks(spark, sf_dir).selectExpr("id as task_id", "filename", "'md' as output_format")
    return _audited(audit.append_download_log(done, _AT))


@check("iso_stamp", "logs", "select id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || case when microsecond(created_at) % 1000000 = 0 then '' else strftime(created_at, '.%f') end as iso from logs")
def iso_stamp(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", T.iso_stamp("created_at").alias("iso"))


@check("stamp", "logs", "select id, strftime(created_at, '%Y%m%d_%H%M%S') as stamp from logs")
def stamp(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", T.stamp("created_at").alias("stamp"))


@check("generated_stamp", "logs", "select id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as stamp from logs")
def generated_stamp(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", T.generated_stamp("created_at").alias("stamp"))


@check(
    "censor_map",
    "",
    """select event_id, k, case when regexp_matches(lower(k), 'password|token|secret|api_key|auth') then '***CENSORED***' else v end as v from (
        select event_id, unnest(['event_type', 'X-' || upper(event_type) || '-Token', 'API_Key', 'author', 'userSecrets', 'props']) as k,
            unnest([event_type, user_id::varchar, 'k' || event_id, 'a', null, props]) as v from events)""",
)
def censor_map(spark, sf_dir):
    maps = given(spark, sf_dir, "events").selectExpr(
        "event_id",
        """map('event_type', event_type, concat('X-', upper(event_type), '-Token'), cast(user_id as string),
            'API_Key', concat('k', event_id), 'author', 'a', 'userSecrets', null, 'props', props) as m""",
    )
    return maps.select("event_id", F.explode(T.censor_map("m")).alias("k", "v"))


@check(
    "metadata_get",
    "tasks",
    "select id, case when status = 'parsed' then filename else '' end as title, '' as author from tasks",
)
def metadata_get(spark, sf_dir):
    entries = "if(status = 'parsed', map('title', filename, 'author', null), map('format', 'TXT'))"
    maps = _tasks(spark, sf_dir).selectExpr("id", f"{entries} as metadata")
    return maps.select("id", T.metadata_get("metadata", "title").alias("title"), T.metadata_get("metadata", "author").alias("author"))
