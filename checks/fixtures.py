"""Derived inputs, stated once as SQL that Spark and DuckDB both run on the given tables.

Each covers its whole source tables. ``{name}`` stands for a given table.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

_TASK_TYPE = (
    "case o_orderkey % 6 when 0 then 'pdf' when 1 then 'docx' when 2 then 'xlsx' when 3 then 'txt' "
    "when 4 then 'md' else 'odt' end"
)
_ITEM_TYPE = (
    "case l_partkey % 8 when 0 then 'name' when 1 then 'id_card' when 2 then 'phone' when 3 then 'address' "
    "when 4 then 'bank_card' when 5 then 'email' when 6 then 'passport' else 'name' end"
)
_PHONE = (
    "concat('1', cast(3 + c_custkey % 7 as string), lpad(cast(c_custkey * 7919 % 1000000000 as string), 9, '0'))"
)
_ID_CARD = "concat(lpad(cast(c_custkey as string), 17, '3'), case when c_custkey % 5 = 0 then 'X' else '7' end)"
_EMAIL = "concat('u', cast(c_custkey as string), '@mail', cast(c_nationkey as string), '.example.com')"
_CARD = "concat(lpad(cast(c_custkey as string), 16, '6'), case when c_custkey % 3 = 0 then '1' else '' end)"
_NAME = "substring('张小明', 1, cast(1 + c_custkey % 3 as int))"
_ADDRESS = "concat('广东省深圳市南山区科技路', cast(c_custkey as string), '号')"

# Texts with name, address and phone at known offsets, then digit runs in which the patterns
# compete, a phone number as e-mail user, repeated values and adjacent spans.
PII_TEXT = f"""concat('姓名', {_NAME}, '地址', {_ADDRESS}, '电话', {_PHONE}, ' NATION_', cast(c_nationkey as string),
  case c_custkey % 8
    when 0 then concat(' 身份证', {_ID_CARD}, '邮箱', {_EMAIL}, ' 卡', {_CARD})
    when 1 then concat(' ', lpad(cast(c_custkey as string), 19, '6'), ' ', {_EMAIL})
    when 2 then concat(' ', lpad(cast(c_custkey as string), 20, '13'), chr(10), {_CARD})
    when 3 then concat(' ', lpad(cast(c_custkey as string), 35, '138'), '😀', {_PHONE})
    when 4 then concat(' ', lpad(cast(c_custkey as string), 36, '4'), 'X ', {_EMAIL})
    when 5 then concat(' ', {_PHONE}, '@qq.com ', {_ID_CARD})
    when 6 then concat(' ', {_PHONE}, ',', {_PHONE}, ',', {_EMAIL}, ',', {_EMAIL})
    else concat(' ', {_PHONE}, {_PHONE}, {_CARD}, {_EMAIL}, 'x') end)"""

PII_ID = "1000000000000 + c_custkey"

FIXTURES = {
    "pii": f"select {PII_ID} as doc_id, {PII_TEXT} as text from {{customer}}",
    "corpus": f"""select doc_id, text from {{documents}}
        union all select {PII_ID} as doc_id, {PII_TEXT} as text from {{customer}}""",
    "entities": f"""
        select {PII_ID} as doc_id, 'PERSON' as label, 2 as start_pos, cast(3 + c_custkey % 3 as int) as end_pos,
          {_NAME} as value from {{customer}}
        union all select {PII_ID}, 'LOC', cast(5 + c_custkey % 3 as int),
          cast(18 + c_custkey % 3 + length(cast(c_custkey as string)) as int), {_ADDRESS} from {{customer}}
        union all select {PII_ID}, 'GPE', cast(5 + c_custkey % 3 as int), cast(11 + c_custkey % 3 as int), '广东省深圳市'
          from {{customer}} where c_custkey % 2 = 0
        union all select {PII_ID}, 'FAC', cast(18 + c_custkey % 3 + length(cast(c_custkey as string)) as int),
          cast(23 + c_custkey % 3 + length(cast(c_custkey as string)) as int), concat('电话', left({_PHONE}, 3))
          from {{customer}} where c_custkey % 3 = 0
        union all select {PII_ID}, 'ORG', 0, 2, '姓名' from {{customer}}""",
    "rules": """select concat('r', cast(s_suppkey as string)) as id, s_name as name,
        case s_suppkey % 8 when 0 then 'name' when 1 then 'id_card' when 2 then 'phone' when 3 then 'address'
          when 4 then 'bank_card' when 5 then 'email' when 6 then 'passport' else 'name' end as data_type,
        case cast(floor(s_suppkey / 8) as bigint) % 4 when 0 then 'mask' when 1 then 'replace' when 2 then 'delete'
          else 'shuffle' end as strategy,
        s_suppkey % 8 in (0, 2, 5) as is_system, s_suppkey % 5 <> 1 as enabled,
        cast(concat('2024-01-', lpad(cast(1 + s_suppkey * 11 % 28 as string), 2, '0'), ' 00:00:00') as timestamp)
          as created_at
        from {supplier}""",
    "tasks": f"""select cast(o_orderkey as string) as id,
        concat('report.', cast(o_orderkey as string), '.', {_TASK_TYPE}) as filename,
        cast(o_custkey * 1000 as bigint) as file_size, {_TASK_TYPE} as file_type, o_orderdate as upload_time,
        case o_orderkey % 5 when 0 then 'uploaded' when 1 then 'parsed' when 2 then 'identified' when 3 then 'completed'
          else 'failed' end as status,
        case o_orderkey % 7 when 0 then null when 1 then '' else concat('订单 ', cast(o_orderkey as string), ' ',
          o_orderpriority, ' 客户 ', cast(o_custkey as string), '，总价 ', cast(cast(floor(o_totalprice) as bigint) as string),
          '。说明：请在收到货物后尽快确认，谢谢。') end as content
        from {{orders}}""",
    "items": f"""select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-',
          cast(l_partkey as string), '-', cast(l_suppkey as string)) as id,
        cast(l_orderkey as string) as task_id, {_ITEM_TYPE} as type,
        concat(case l_partkey % 8 when 5 then 'user@' when 3 then '广东省广州市' else '' end,
          lpad(cast(l_suppkey as string), cast(l_partkey % 20 as int), '13')) as value,
        cast(l_partkey % 40 as int) as start_pos, cast(l_partkey % 40 + l_suppkey % 12 - 1 as int) as end_pos,
        case l_linenumber % 3 when 0 then 0.5e0 when 1 then 0.8e0 else 1.0e0 end as confidence
        from {{lineitem}}""",
    "logs": """select cast(event_id as string) as id, cast(user_id as string) as task_id,
        case event_type when 'signup' then 'upload' when 'click' then 'desensitization' when 'error' then 'upload'
          else 'download' end as operation_type,
        concat('{{"filename":"f', cast(event_id as string), '.txt","output_format":"md","note":"a, b"}}') as details,
        ts as created_at
        from {events}""",
    "intake": """select concat(p_name, ' ', cast(p_partkey as string), case p_partkey % 12 when 0 then '.pdf' when 1 then '.DOCX'
          when 2 then '.xlsx' when 3 then '.txt' when 4 then '.md' when 5 then '.exe' when 6 then '.jpg' when 7 then '.Pdf.zip'
          when 8 then '.csv' when 9 then '' when 10 then '/.txt' else '.tar.TXT' end) as filename,
        52428800 - 3 + p_partkey % 7 as size
        from {part}""",
    "benchmark_pii": """select item_id, concat(text, ' u', cast(item_id as string), '@mail.example.com 1', cast(3 + item_id % 7 as string),
          lpad(cast(item_id as string), 9, '0')) as text
        from {benchmark}""",
    "pages_of_doc": """select conv_id as doc_id, turn as page_no,
          case when turn % 3 = 2 or conv_id % 11 = 0 then concat(' ', chr(10), chr(9)) else text end as text
        from {conversations}
        union all select o_orderkey + 1000000, o_custkey, case when o_custkey % 4 = 0 then '' else concat(o_orderpriority, ' ', cast(o_orderdate as date)) end
        from {orders}""",
    "paras": """select o_orderkey as doc_id, 0 as para_no, concat(' Order ', cast(o_orderkey as string), ' ') as text from {orders}
          where o_orderkey % 9 <> 0
        union all select o_orderkey, 2, ' ' from {orders}
        union all select o_orderkey, 1, o_orderpriority from {orders} where o_orderkey % 2 = 0 and o_orderkey % 9 <> 0""",
    "table_cells": """select l_orderkey as doc_id, l_linenumber % 2 as table_no, l_linenumber as row_no, l_suppkey as col_no,
          case when l_orderkey % 9 = 0 or l_suppkey % 6 = 0 then ' ' else concat(' ', cast(l_partkey as string), chr(9)) end as text
        from {lineitem}""",
    "sheet_cells": """select l_orderkey as doc_id, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as sheet_ix,
          concat('Flag ', l_returnflag) as sheet_name, l_linenumber as row_ix, l_partkey % 10 as col_ix,
          case when l_orderkey % 13 = 0 or l_suppkey % 7 = 0 then null when l_suppkey % 7 = 1 then ' '
            else concat(cast(l_partkey as string), ' x ') end as value
        from {lineitem}""",
    "layout": """select o_orderkey + 1000000 as doc_id, concat(
          case when o_orderkey % 3 = 0 then concat('intro ', o_orderpriority, chr(10)) else '' end,
          case when o_orderkey % 2 = 0 then concat(' === Sheet: S', cast(o_orderkey as string), ' a name well over thirty-one characters === ', chr(10)) else '' end,
          'a | b | ', cast(o_custkey as string), chr(10),
          case when o_orderkey % 5 = 0 then concat(chr(10), ' ', chr(10)) else '' end,
          'c |  d', chr(10),
          case when o_orderkey % 7 = 0 then concat('=== Sheet: x | y ===', chr(10)) else '' end,
          case when o_orderkey % 11 = 0 then concat('e | f | g | h', chr(10), '=== Sheet: x === 2 ===', chr(10)) else '' end,
          'end', case when o_orderkey % 4 = 0 then concat(chr(10), '=== Sheet:===', chr(10), '=== Sheet: p | q ===', chr(10), '=== Sheet: last ===') else '' end
          ) as content from {orders}
        union all select doc_id, text as content from {documents}
        union all select doc_id - 1000000000, case doc_id % 3 when 0 then '' when 1 then concat(' ', chr(10)) else '=== Sheet: only ===' end from {labels}""",
    "files": """select concat('/in/', source, '/', cast(doc_id as string), case doc_id % 7 when 5 then '.md' when 6 then '.pdf' else '.TXT' end) as file,
          case when doc_id % 10 = 3 then '' when doc_id % 10 = 7 then concat(' ', chr(10)) else text end as text, doc_id
        from {documents}""",
}

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _tables(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    sql = FIXTURES[name]
    return spark.sql(sql, **{t: given(spark, sf_dir, t) for t in _tables(sql)})


def ctes(names: str) -> str:
    """Fixtures as the common table expressions of a DuckDB query, after their names."""
    return ", ".join(
        f"{n} as materialized ({FIXTURES[n].format(**{t: t for t in GIVEN})})" for n in names.split()
    )
