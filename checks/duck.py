"""DuckDB statements of the semantics, written relationally and apart from the Spark code."""

from __future__ import annotations

REGEX = {
    "id_card": r"\p{Nd}{17}[\p{Nd}Xx]",
    "bank_card": r"\p{Nd}{16,19}",
    "phone": r"1[3-9]\p{Nd}{9}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
}
PRIORITY = list(REGEX)


def matches(table: str, regex: str, out: str, key: str = "doc_id", text: str = "text") -> str:
    """CTE of the matches of a pattern, one row each: (key, s, e, value)."""
    return f"""
    {out}_raw as (select {key}, regexp_extract_all({text}, '{regex}') as v, string_split_regex({text}, '{regex}') as g
        from {table}),
    {out}_each as (select {key}, unnest(v) as value, unnest(g[1:len(v)]) as gap, unnest(range(len(v))) as i
        from {out}_raw where len(v) > 0),
    {out} as (select {key}, value, cast(upto - length(value) as bigint) as s, cast(upto as bigint) as e from (
        select *, sum(length(gap) + length(value)) over (partition by {key} order by i) as upto from {out}_each))"""


def structured(table: str, key: str = "doc_id", text: str = "text") -> str:
    """CTEs ending in ``structured`` (key, s, e, type, value, conf): patterns by priority."""
    parts, kept = [], []
    for kind in PRIORITY:
        parts.append(matches(table, REGEX[kind], f"m_{kind}", key, text))
        clear = " and ".join(
            f"not exists (select 1 from k_{k} k where k.{key} = m.{key} and k.s < m.e and m.s < k.e)" for k in kept
        )
        parts.append(f"\n    k_{kind} as (select m.* from m_{kind} m {'where ' + clear if clear else ''})")
        kept.append(kind)
    union = " union all ".join(
        f"select {key}, s, e, '{k}' as type, value, 1.0::double as conf, 0 as src from k_{k}" for k in PRIORITY
    )
    parts.append(f"\n    structured as ({union})")
    return ",".join(parts)


ENTITY_ITEMS = """
    entity_items as (select doc_id, start_pos::bigint as s, end_pos::bigint as e,
        case label when 'PERSON' then 'name' else 'address' end as type, value, 0.8::double as conf, 1 as src
        from entities where label in ('PERSON', 'GPE', 'LOC', 'FAC'))"""


def merged(source: str, out: str = "merged", key: str = "doc_id") -> str:
    """CTEs ending in ``out``: the items of ``source`` after resolving overlaps.

    A recursion walks each document in order and carries the last kept item.
    """
    return f"""
    {out}_in as (select *, row_number() over (partition by {key} order by s, e, src, type, value, conf) as rn from {source}),
    {out}_walk as (
        select {key}, rn, s, e, type, value, conf, 1 as grp from {out}_in where rn = 1
        union all
        select w.{key}, x.rn,
            case when take then x.s else w.s end, case when take then x.e else w.e end,
            case when take then x.type else w.type end, case when take then x.value else w.value end,
            case when take then x.conf else w.conf end, case when clash then w.grp else w.grp + 1 end
        from {out}_walk w join (select * from {out}_in) x on x.{key} = w.{key} and x.rn = w.rn + 1,
            lateral (select x.e > w.s and x.s < w.e as clash),
            lateral (select not clash or x.conf > w.conf or (x.conf = w.conf and x.conf = 1.0) as take)),
    {out} as (select {key}, s, e, type, value, conf from {out}_walk
        qualify row_number() over (partition by {key}, grp order by rn desc) = 1)"""


FIRST_RULE = """
    first_rule as (select data_type, id, name, strategy from rules where enabled
        qualify row_number() over (partition by data_type order by created_at, id) = 1)"""

MASK = {
    "name": "case when length(v) <= 1 then v else left(v, 1) || repeat('*', length(v) - 1) end",
    "id_card": "case when length(v) < 18 then v else left(v, 6) || '********' || right(v, 4) end",
    "phone": "case when length(v) < 11 then v else left(v, 3) || '****' || right(v, 4) end",
    "address": """case when regexp_matches(v, '^.*?[省市].*?[市区县]') then regexp_extract(v, '^(.*?[省市].*?[市区县])', 1) || '******'
        when regexp_matches(v, '^.*?[市区县]') then regexp_extract(v, '^(.*?[市区县])', 1) || '******'
        when length(v) > 6 then left(v, 6) || '******' else '******' end""",
    "bank_card": "case when length(v) < 8 then v else left(v, 4) || repeat('*', length(v) - 8) || right(v, 4) end",
    "email": """case when instr(v, '@') = 0 then v when instr(v, '@') <= 2 then '*' || substr(v, instr(v, '@'))
        else left(v, 1) || '***' || substr(v, instr(v, '@')) end""",
    "default": "case when length(v) <= 2 then repeat('*', length(v)) else left(v, 1) || repeat('*', length(v) - 2) || right(v, 1) end",
}

PLACEHOLDER = """case {t} when 'name' then '[姓名]' when 'id_card' then '[身份证]' when 'phone' then '[电话]'
    when 'address' then '[地址]' when 'bank_card' then '[银行卡]' when 'email' then '[邮箱]' else '[敏感信息]' end"""


def _of(expr: str, value: str) -> str:
    import re

    return re.sub(r"\bv\b", value, expr)


def mask(value: str, type_: str) -> str:
    arms = " ".join(f"when {type_} = '{k}' then {_of(e, value)}" for k, e in MASK.items() if k != "default")
    return f"(case when {value} = '' then {value} {arms} else {_of(MASK['default'], value)} end)"


def rewrite(value: str, type_: str, strategy: str) -> str:
    return (
        f"(case {strategy} when 'mask' then {mask(value, type_)} when 'replace' then "
        f"{PLACEHOLDER.format(t=type_)} when 'delete' then '' end)"
    )


def spliced(docs: str, edits: str, out: str = "spliced", key: str = "doc_id", text: str = "text") -> str:
    """CTEs ending in ``out`` (key, deid_text): disjoint edits (key, s, e, nv) put into the texts."""
    return f"""
    {out}_lag as (select {key}, s, e, nv, coalesce(lag(e) over (partition by {key} order by s, e), 0) as prev from {edits}),
    {out}_parts as (select l.{key}, string_agg(substring(d.{text}, prev + 1, s - prev) || nv, '' order by s, e) as head, max(e) as done
        from {out}_lag l join {docs} d on d.{key} = l.{key} group by l.{key}),
    {out} as (select d.{key}, case when p.{key} is null then d.{text} else p.head || substring(d.{text}, p.done + 1) end as deid_text
        from {docs} d left join {out}_parts p on p.{key} = d.{key})"""


def sequential(source: str, out: str, key: str) -> str:
    """CTEs ending in ``out`` (key, deid_text): edits of ``source`` (key, text, s, e, nv, ord), which
    may overlap, applied one after the other from the highest start down."""
    return f"""
    {out}_in as (select *, row_number() over (partition by {key} order by s desc, ord) as rn from {source}),
    {out}_walk as (
        select {key}, rn, left(text, s) || nv || substring(text, e + 1) as t from {out}_in where rn = 1
        union all
        select w.{key}, x.rn, left(w.t, x.s) || x.nv || substring(w.t, x.e + 1)
        from {out}_walk w join (select * from {out}_in) x on x.{key} = w.{key} and x.rn = w.rn + 1),
    {out} as (select {key}, t as deid_text from {out}_walk qualify row_number() over (partition by {key} order by rn desc) = 1)"""


BLANK = "trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def strip(x: str) -> str:
    return BLANK.format(x=x)


def lines(table: str, out: str, key: str = "doc_id", text: str = "content") -> str:
    """CTE of stripped lines (key, i, line)."""
    return f"""
    {out} as (select {key}, unnest(range(len(l))) as i, {strip('unnest(l)')} as line
        from (select {key}, string_split({text}, chr(10)) as l from {table}))"""


HEADER = "(starts_with(line, '=== Sheet:') and ends_with(line, '==='))"
SHEET_NAME = strip("replace(replace(line, '=== Sheet:', ''), '===', '')")
EXT = "lower(regexp_extract({x}, '[^/.][^/]*(\\.[^/.]*)$', 1))"
