"""Files: intake, decoding, names, batch outcome, streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import duck
from checks.fixtures import fx, given
from checks.registry import check
from inkveil.functions import text as T
from inkveil.operators import audit
from inkveil.plans import pipeline
from inkveil.sources import encodings, files, sinks
from inkveil.streaming import deidentify as stream
from inkveil.streaming import task_states

_EXT = duck.EXT.format(x="filename")
_ALLOWED = "('.pdf', '.docx', '.xlsx', '.txt', '.md')"


@check(
    "validate_intake",
    "intake",
    f"""select filename, size::bigint as size, case when {_EXT} not in {_ALLOWED} then 'UNSUPPORTED_FORMAT' when size > 52428800 then 'FILE_SIZE_EXCEEDED' end
        as reject_code from intake""",
)
def validate_intake(spark, sf_dir):
    checked = files.validate_intake(fx(spark, sf_dir, "intake"))
    return checked.select("filename", F.col("size").cast("bigint").alias("size"), "reject_code")


@check("file_ext", "intake", f"select filename, {_EXT} as ext from intake")
def file_ext(spark, sf_dir):
    return fx(spark, sf_dir, "intake").select("filename", T.file_ext("filename").alias("ext"))


@check("file_type_of", "intake", f"select filename, substr({_EXT}, 2) as file_type from intake where {_EXT} in {_ALLOWED}")
def file_type_of(spark, sf_dir):
    checked = files.validate_intake(fx(spark, sf_dir, "intake")).where("reject_code is null or reject_code <> 'UNSUPPORTED_FORMAT'")
    return checked.select("filename", T.file_type_of("ext").alias("file_type"))


@check(
    "register_task",
    "intake",
    f"""select filename, size::bigint as file_size, substr({_EXT}, 2) as file_type, 'uploaded' as status, copy,
        2 * (select count(*) from intake where {_EXT} in {_ALLOWED} and size <= 52428800)::bigint as distinct_ids
    from intake, (select unnest([1, 2]) as copy) where {_EXT} in {_ALLOWED} and size <= 52428800""",
)
def register_task(spark, sf_dir):
    accepted = files.validate_intake(fx(spark, sf_dir, "intake")).where("reject_code is null")
    twice = accepted.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))  # repeated names
    rows = files.register_task(twice, F.expr("timestamp'2024-05-06 07:08:09'"))
    copy = F.row_number().over(Window.partitionBy("filename").orderBy("id")).alias("copy")
    ids = rows.agg(F.countDistinct("id")).scalar().alias("distinct_ids")
    return rows.select("filename", "file_size", "file_type", "status", copy, ids)


@check(
    "parse_route",
    "tasks",
    """select id, case when file_type in ('pdf', 'docx', 'xlsx', 'txt') then file_type else 'UNSUPPORTED_FORMAT' end as strict,
        case when file_type in ('pdf', 'docx', 'xlsx', 'txt') then file_type when file_type = 'md' then 'txt' else 'UNSUPPORTED_FORMAT' end as route
    from tasks""",
)
def parse_route(spark, sf_dir):
    kind = F.upper("file_type")
    return fx(spark, sf_dir, "tasks").select(
        "id", files.parse_route(kind, strict=True).alias("strict"), files.parse_route(kind).alias("route")
    )


@check(
    "export_route",
    "tasks",
    """select id, case when file_type in ('txt', 'md', 'docx', 'xlsx') then file_type else 'UNSUPPORTED_FORMAT' end as route,
        case when file_type = 'pdf' then 'txt' else file_type end as same from tasks""",
)
def export_route(spark, sf_dir):
    kind = F.upper("file_type")
    return fx(spark, sf_dir, "tasks").select(
        "id", sinks.export_route(kind).alias("route"), sinks.same_as_input(kind).alias("same")
    )


@check(
    "export_filename",
    "tasks",
    """select id, regexp_replace(filename, '\\.[^.]*$', '') || '_desensitized_' || strftime(upload_time, '%Y%m%d_%H%M%S') || '.md' as name
    from tasks""",
)
def export_filename(spark, sf_dir):
    return fx(spark, sf_dir, "tasks").select("id", T.export_filename("filename", "'md'", "upload_time").alias("name"))


@check(
    "output_path",
    "intake",
    """, p as (select filename, case when size % 2 = 0 then '/in/base/d' || size % 5 || '/' || filename else '/elsewhere/' || filename end as path from intake),
    s as (select path, string_split(path, '/')[-1] as name, case when starts_with(path, '/in/base/') then substr(path, 10) else string_split(path, '/')[-1] end as rel
        from p)
    select path, '/out/' || left(rel, length(rel) - length(name)) || case when regexp_matches(name, '^.+\\.[^.]+$')
        then regexp_extract(name, '^(.+)(\\.[^.]+)$', 1) || '_desensitized' || regexp_extract(name, '^(.+)(\\.[^.]+)$', 2)
        else name || '_desensitized' end as out_path from s""",
)
def output_path(spark, sf_dir):
    paths = fx(spark, sf_dir, "intake").selectExpr(
        "if(size % 2 = 0, concat('/in/base/d', size % 5, '/', filename), concat('/elsewhere/', filename)) as path"
    )
    return paths.select("path", T.output_path("path", "/in/base", "/out").alias("out_path"))


# --- decoding ---------------------------------------------------------------------------

_CODE = f"case when text = '' then 'EMPTY_DOCUMENT' when {duck.strip('text')} = '' then 'NO_CONTENT' end"


@check(
    "decode_text",
    "files",
    f"""select file, kind, case when {_CODE} is null and kind <> 'noise' then text end as text,
        case kind when 'utf-8' then 'utf-8' when 'utf-16le' then 'utf-16' when 'utf-16be' then 'utf-16' end as encoding,
        case when kind = 'noise' then 'ENCODING_ERROR' else {_CODE} end as error_code
    from (select file, text, unnest(['utf-8', 'utf-16le', 'utf-16be', 'noise']) as kind from files) where text <> ''""",
)
def decode_text(spark, sf_dir):
    """Every text as UTF-8, as UTF-16 in both byte orders with its mark, and as bytes that are no text."""
    made = {
        "utf-8": "cast(text as binary)",
        "utf-16le": "concat(X'FFFE', encode(text, 'UTF-16LE'))",
        "utf-16be": "concat(X'FEFF', encode(text, 'UTF-16BE'))",
        "noise": "concat(X'0080FF', cast(text as binary), X'81')",
    }
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(sql).alias("content")) for k, sql in made.items())))
    raw = fx(spark, sf_dir, "files").where("text <> ''").select("file", kinds.alias("x")).select("file", "x.*")
    decoded = files.decode_text(raw)
    return decoded.select("file", "kind", F.when(F.col("error_code").isNull(), F.col("text")).alias("text"), "encoding", "error_code")


_PII_GB = "text not like '%😀%'"


@check(
    "detect_encodings",
    "pii",
    f"""select doc_id, unnest(['utf-16-le', 'utf-16-be']) as encoding, text as read from documents where length(text) >= 20
    union all select doc_id, unnest(['utf-16-le', 'utf-16-be']), text from pii
    union all select doc_id, 'gbk', text from pii where {_PII_GB}
    union all select doc_id, 'latin-1', text from documents where length(text) >= 20 and regexp_matches(text, '[^\\x00-\\x7F]')
        and regexp_full_match(text, '[\\x00-\\x{{FF}}]*', 's')""",
)
def detect_encodings(spark, sf_dir):
    """Documents and Chinese texts in encodings without a mark, read by a model of the same texts in UTF-8."""
    docs = given(spark, sf_dir, "documents").where("length(text) >= 20").select("doc_id", "text")
    pii = fx(spark, sf_dir, "pii")
    both = docs.unionByName(pii)
    made = [both.selectExpr("doc_id", f"'{name}' as truth", f"encode(text, '{java}') as content") for name, java in (("utf-16-le", "UTF-16LE"), ("utf-16-be", "UTF-16BE"))]
    gbk = F.udf(lambda text: text.encode("gbk"), "binary")
    made.append(pii.where(_PII_GB).select("doc_id", F.lit("gbk").alias("truth"), gbk("text").alias("content")))
    latin = docs.where(r"text rlike '[^\\x00-\\x7F]' and not text rlike '[^\\x00-\\xFF]'")
    made.append(latin.selectExpr("doc_id", "'latin-1' as truth", "encode(text, 'ISO-8859-1') as content"))
    raw = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    decoded = files.decode_text(raw, model=encodings.learn_encodings(both))
    return decoded.select("doc_id", F.col("truth").alias("encoding"), F.when(F.col("encoding") == F.col("truth"), F.col("text")).alias("read"))


@check(
    "text_metadata",
    "files",
    """select file, 'TXT' as format, 'utf-8' as encoding, strlen(text) as size_bytes,
        length(text) - length(replace(text, chr(10), '')) + case when text <> '' and right(text, 1) <> chr(10) then 1 else 0 end as line_count
    from files""",
)
def text_metadata(spark, sf_dir):
    rows = fx(spark, sf_dir, "files")
    meta = files.text_metadata("text", F.octet_length("text"), F.lit("utf-8"))
    return rows.select("file", meta.alias("m")).select("file", "m.*")


def _written_files(spark, sf_dir):
    """The documents as text files, one folder per language, in the shared folder."""
    folder = sinks.shared_folder(spark, "files")
    given(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(folder)
    return folder


@check("scan_files", "", "select lang, '.txt' as ext, sum(strlen(text) + 1)::bigint as length from documents group by lang")
def scan_files(spark, sf_dir):
    found = files.scan_files(spark, _written_files(spark, sf_dir))
    lang = F.regexp_extract("path", "/lang=([^/]*)/", 1)
    return found.groupBy(lang.alias("lang"), "ext").agg(F.sum("length").alias("length"))


@check("export_text", "", "select '/out/' || source || '/' || doc_id || '.txt' as out_path, text as content from documents")
def export_text(spark, sf_dir):
    """A file per document, in folders by source; what is read back."""
    folder = files.qualified(spark, sinks.shared_folder(spark, "export"))
    docs = given(spark, sf_dir, "documents")
    path = F.concat(F.lit(folder + "/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    sinks.export_text(docs.select(path.alias("out_path"), F.col("text").alias("content")), folder)
    found = files.read_files(spark, folder)
    name = F.concat(F.lit("/out"), F.expr(f"substring(path, {len(folder) + 1})"))
    return found.select(name.alias("out_path"), F.col("content").cast("string").alias("content"))


# --- batch ------------------------------------------------------------------------------


def _outcome(spark, sf_dir):
    rows = fx(spark, sf_dir, "files").withColumn("content", F.col("text").cast("binary")).drop("text")
    sized = rows.withColumn("ext", T.file_ext("file")).withColumn("length", F.octet_length("content"))
    return pipeline.process_texts(sized, fx(spark, sf_dir, "rules"))


_OUTCOME = f""", o as (select file, text, doc_id, case when ends_with(file, '.pdf') then 'ASSEMBLED_ELSEWHERE' else {_CODE} end as error_code from files)"""


@check(
    "batch_outcome",
    "files rules",
    f"""{_OUTCOME}, good as (select doc_id, text from o where error_code is null), {duck.structured('good')},
    {duck.FIRST_RULE}, edits as (select doc_id, s, e, {duck.rewrite('value', 'type', 'strategy')} as nv from structured join first_rule on data_type = type),
    known as (select * from edits where nv is not null), {duck.spliced('good', 'known')}
    select file, deid_text, error_code from o left join spliced using (doc_id)""",
)
def batch_outcome(spark, sf_dir):
    return _outcome(spark, sf_dir).select("file", "deid_text", "error_code")


@check(
    "batch_summary",
    "files",
    f"""{_OUTCOME} select count(*) as total_files, count(*) filter (error_code is null) as successful_files,
        count(*) filter (error_code is not null) as failed_files, count(*) filter (error_code is not null) = 0 as ok from o""",
)
def batch_summary(spark, sf_dir):
    return audit.batch_summary(_outcome(spark, sf_dir))


_MESSAGE = """case error_code when 'EMPTY_DOCUMENT' then 'TXT file is empty' when 'NO_CONTENT' then 'No text content found in TXT file'
    else 'Read by the assembly operators: pdf' end"""


@check("batch_errors", "files", f"{_OUTCOME} select file, 'Parsing error: ' || {_MESSAGE} as error from o where error_code is not null")
def batch_errors(spark, sf_dir):
    return audit.batch_errors(_outcome(spark, sf_dir))


def no_dollars(text):
    """A recogniser that finds nothing and fails on dollar signs."""
    if "$" in text:
        raise ValueError("dollars")
    return []


@check(
    "batch_recognition_errors",
    "files",
    f"""{_OUTCOME} select file, 'Parsing error: ' || {_MESSAGE} as error from o where error_code is not null
    union all select file, 'Recognition error: ValueError: dollars' from o where error_code is null and contains(text, '$')""",
)
def batch_recognition_errors(spark, sf_dir):
    """Errors of both stages, with a user's recogniser in the batch run."""
    rows = fx(spark, sf_dir, "files").withColumn("content", F.col("text").cast("binary")).drop("text")
    sized = rows.withColumn("ext", T.file_ext("file")).withColumn("length", F.octet_length("content"))
    return audit.batch_errors(pipeline.process_texts(sized, fx(spark, sf_dir, "rules"), find=no_dollars))


@check(
    "error_row",
    "files",
    f"{_OUTCOME} select file, error_code, {_MESSAGE} as message, file as details from o where error_code is not null",
)
def error_row(spark, sf_dir):
    failed = _outcome(spark, sf_dir).where("error_code is not null")
    triple = T.error_row("error_code", "message", "file")
    return failed.select("file", triple.alias("e")).select("file", "e.*")


# --- streams ----------------------------------------------------------------------------


def arriving_rows(spark, sf_dir, name, schema):
    """A given table as a stream, be it one file or a folder of files.

    Only a pattern lets a stream read a path that may be a file: its last letter stands in brackets.
    """
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@check(
    "stream_deidentify",
    "rules",
    f""", {duck.structured('documents')}, {duck.FIRST_RULE},
    edits as (select doc_id, s, e, {duck.rewrite('value', 'type', 'strategy')} as nv from structured join first_rule on data_type = type),
    known as (select * from edits where nv is not null), {duck.spliced('documents', 'known')},
    counts as (select doc_id, count(*) as n, count(*) filter (type in (select data_type from first_rule)) as d from structured group by doc_id)
    select doc_id, deid_text, coalesce(n, 0) as total_items, coalesce(d, 0) as desensitized_items from spliced left join counts using (doc_id)""",
)
def stream_deidentify(spark, sf_dir):
    arriving = arriving_rows(spark, sf_dir, "documents", "doc_id bigint, text string")
    folder = sinks.shared_folder(spark, "stream")
    query = stream.stream_deidentify(
        arriving, fx(spark, sf_dir, "rules"), f"{folder}/texts", f"{folder}/audit", f"{folder}/checkpoint"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/texts").drop("batch_id", "applied_rules")


def write_each(lines, folder):
    """One file per document, with a line per row of it; many tasks write the files, and none moves those of others."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = files.qualified(lines.sparkSession, folder)
    texts = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.coalesce("text", F.lit("")))).alias("lines"))
    number = F.pmod(F.hash("doc_id"), F.lit(tasks)).cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    path = F.concat(F.lit(f"{folder}/doc_id="), name, F.lit("/part-"), number, F.lit("-text.txt"))
    sinks.export_text(texts.select(path.alias("out_path"), F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("content")), folder)


@check(
    "stream_files",
    "rules",
    f""", one as (select doc_id, regexp_replace(text, '[\\r\\n\\v\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g') as text from documents), {duck.structured('one')}, {duck.FIRST_RULE},
    edits as (select doc_id, s, e, {duck.rewrite('value', 'type', 'strategy')} as nv from structured join first_rule on data_type = type),
    known as (select * from edits where nv is not null), {duck.spliced('one', 'known')}
    select doc_id, deid_text || chr(10) as deid_text from spliced""",
)
def stream_files(spark, sf_dir):
    """One text file per document arriving in a folder, its text on one line; the rewritten texts."""
    lines = given(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace("text", r"[\r\n\x0b\f\x1c-\x1e\x85\u2028\u2029]", " ").alias("text")
    )
    incoming = sinks.shared_folder(spark, "files")
    write_each(lines, incoming)
    folder = sinks.shared_folder(spark, "stream")
    files_ = stream.read_files_stream(spark, incoming)
    stream.stream_files(files_, fx(spark, sf_dir, "rules"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{folder}/out")
    return done.select(F.regexp_extract("file", "/doc_id=([0-9]+)/", 1).cast("bigint").alias("doc_id"), "deid_text")


@check(
    "stream_task_states",
    "",
    """, e as (select user_id, list({'stage': case event_type when 'signup' then 'parse' when 'error' then 'parse' when 'click' then 'identify' else 'export' end,
            'failed': event_type = 'error'} order by ts, event_id) as es from events group by user_id),
    folded as (select user_id, list_reduce(list_prepend({'status': 'uploaded', 'content': false, 'stage': '', 'failed': false, 'accepted': 0, 'refused': 0},
        list_transform(es, lambda x: {'status': '', 'content': false, 'stage': x.stage, 'failed': x.failed, 'accepted': 0, 'refused': 0})),
        lambda a, x: case
            when x.stage = 'parse' and a.status = 'uploaded' then {'status': case when x.failed then 'failed' else 'parsed' end, 'content': not x.failed, 'stage': '', 'failed': false, 'accepted': a.accepted + 1, 'refused': a.refused}
            when x.stage = 'identify' and a.status = 'parsed' then {'status': 'identified', 'content': a.content, 'stage': '', 'failed': false, 'accepted': a.accepted + 1, 'refused': a.refused}
            when x.stage = 'export' and a.content then {'status': 'completed', 'content': a.content, 'stage': '', 'failed': false, 'accepted': a.accepted + 1, 'refused': a.refused}
            else {'status': a.status, 'content': a.content, 'stage': '', 'failed': false, 'accepted': a.accepted, 'refused': a.refused + 1} end) as s from e)
    select user_id::varchar as task_id, s.status as status, s.accepted::bigint as accepted, s.refused::bigint as refused from folded""",
)
def stream_task_states(spark, sf_dir):
    """Events as they are stored, in no order of time, as a stream; the last state of every task."""
    arriving = arriving_rows(spark, sf_dir, "events", "event_id bigint, user_id bigint, event_type string, ts timestamp")
    kind = F.when(F.col("event_type").isin("signup", "error"), "parse").when(F.col("event_type") == "click", "identify").otherwise("export")
    error = F.when(F.col("event_type") == "error", "FAILED")
    events = arriving.select("event_id", F.col("user_id").alias("task_id"), F.col("ts").alias("at"), kind.alias("stage"), error.alias("error_code"))
    folder = sinks.shared_folder(spark, "states")
    task_states.stream_task_states(events, f"{folder}/out", f"{folder}/checkpoint", "3650 days").awaitTermination()
    return task_states.latest_states(spark, f"{folder}/out")
