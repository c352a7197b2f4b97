"""Layout text: assembling it from tables and reading it back."""

from pyspark.sql import functions as F

from checks import duck
from checks.fixtures import fx
from checks.registry import check
from inkveil.functions import text as T
from inkveil.operators import assemble, layout
from inkveil.operators.rows import explode_rows


def _long(df, *columns):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in columns else F.col(c) for c in df.columns])


# --- assembly ---------------------------------------------------------------------------


@check(
    "assemble_pages",
    "pages_of_doc",
    f""", p as (select doc_id, count(*) as n, string_agg(text, chr(10) order by page_no, text) filter ({duck.strip('text')} <> '') as content
        from pages_of_doc group by doc_id)
    select c_custkey + 0 as doc_id, null as content, 0 as page_count, 'EMPTY_DOCUMENT' as error_code from customer
        where c_custkey not in (select doc_id from p)
    union all select doc_id, content, n, case when content is null then 'NO_CONTENT' end from p""",
)
def assemble_pages(spark, sf_dir):
    pages = fx(spark, sf_dir, "pages_of_doc")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"))
    known = customers.unionByName(pages.select("doc_id")).distinct()
    return assemble.assemble_pages(pages, docs=known)


_CONCAT = "select doc_id, string_agg(text, chr(10) order by page_no, text) as text from pages_of_doc group by doc_id"


@check("concat_agg", "pages_of_doc", _CONCAT)
def concat_agg(spark, sf_dir):
    return assemble.concat_agg(fx(spark, sf_dir, "pages_of_doc"), ["doc_id"], "page_no", "text", "\n")


@check(
    "assemble_paragraphs_tables",
    "paras table_cells",
    f""", t_rows as (select doc_id, table_no, row_no, string_agg({duck.strip('text')}, ' | ' order by col_no, {duck.strip('text')}) as line
        from table_cells where {duck.strip('text')} <> '' group by doc_id, table_no, row_no),
    parts as (select doc_id, -1 as part, para_no as i, text as line from paras where {duck.strip('text')} <> ''
        union all select doc_id, table_no, row_no, line from t_rows),
    docs as (select doc_id from paras union select doc_id from table_cells),
    content as (select doc_id, string_agg(line, chr(10) order by part, i) as content from parts group by doc_id)
    select doc_id, content, case when content is null then 'PARSING_FAILED' end as error_code from docs left join content using (doc_id)""",
)
def assemble_paragraphs_tables(spark, sf_dir):
    return assemble.assemble_paragraphs_tables(fx(spark, sf_dir, "paras"), fx(spark, sf_dir, "table_cells"))


_SHEETS = f"""s_rows as (select doc_id, sheet_ix, sheet_name, row_ix, string_agg(value, ' | ' order by col_ix, value) as line
        from sheet_cells where {duck.strip('value')} <> '' group by all),
    s_lines as (select doc_id, sheet_ix, row_ix, line from s_rows
        union all select distinct doc_id, sheet_ix, -1, '=== Sheet: ' || sheet_name || ' ===' from s_rows),
    s_content as (select doc_id, string_agg(line, chr(10) order by sheet_ix, row_ix) as content from s_lines group by doc_id)"""


@check(
    "assemble_sheets",
    "sheet_cells",
    f""", {_SHEETS}, counts as (select doc_id, count(distinct sheet_ix) as sheet_count,
            count(*) filter ({duck.strip('value')} <> '') as non_empty_cells from sheet_cells group by doc_id)
    select doc_id, content, sheet_count, non_empty_cells, case when content is null then 'PARSING_FAILED' end as error_code
    from counts left join s_content using (doc_id)""",
)
def assemble_sheets(spark, sf_dir):
    return assemble.assemble_sheets(fx(spark, sf_dir, "sheet_cells"))


@check(
    "sheet_info",
    "sheet_cells",
    f"""select doc_id, sheet_ix::bigint as sheet_ix, min(sheet_name) as name, max(row_ix)::bigint as rows, max(col_ix)::bigint as columns
    from sheet_cells group by doc_id, sheet_ix having count(*) filter ({duck.strip('value')} <> '') > 0""",
)
def sheet_info(spark, sf_dir):
    return _long(assemble.sheet_info(fx(spark, sf_dir, "sheet_cells")), "sheet_ix", "rows", "columns")


@check(
    "non_empty_cells",
    "sheet_cells",
    f"select doc_id, count(*) filter ({duck.strip('value')} <> '') as non_empty_cells from sheet_cells group by doc_id",
)
def non_empty_cells(spark, sf_dir):
    return assemble.non_empty_cells(fx(spark, sf_dir, "sheet_cells"))


@check(
    "doc_structure",
    "pages_of_doc paras table_cells sheet_cells",
    """, pg as (select doc_id, count(*) as pages from pages_of_doc group by doc_id),
    pa as (select doc_id, count(*) as paragraphs from paras group by doc_id),
    tb as (select doc_id, count(distinct table_no) as tables from table_cells group by doc_id),
    sh as (select doc_id, count(distinct sheet_ix) as sheets from sheet_cells group by doc_id)
    select doc_id, coalesce(pages, 0) as pages, coalesce(paragraphs, 0) as paragraphs, coalesce(tables, 0) as tables,
        coalesce(sheets, 0) as sheets
    from pg full join pa using (doc_id) full join tb using (doc_id) full join sh using (doc_id)""",
)
def doc_structure(spark, sf_dir):
    names = ("pages_of_doc", "paras", "table_cells", "sheet_cells")
    return assemble.doc_structure(*[fx(spark, sf_dir, n) for n in names])


# --- reading back -----------------------------------------------------------------------

_LINES = f", {duck.lines('layout', 'l')}, nb as (select *, row_number() over (partition by doc_id order by i) - 1 as n from l where line <> '')"
_SHEET_ROWS = f"""{_LINES},
    h as (select *, {duck.HEADER} as is_header from nb),
    sh as (select *, count(*) filter (is_header) over (partition by doc_id order by n) as headers,
        coalesce(bool_or(n = 0 and not is_header) over (partition by doc_id), false) as bare_start from h),
    named as (select *, coalesce(last_value(case when is_header then {duck.SHEET_NAME} end ignore nulls)
            over (partition by doc_id order by n rows between unbounded preceding and current row), 'Sheet1') as sheet,
        headers + bare_start::int as sheet_no,
        count(*) filter (not is_header) over (partition by doc_id, headers order by n) as row_in_sheet from sh)"""


@check(
    "sheet_of_line",
    "layout",
    f"""{_SHEET_ROWS} select doc_id, i as line_no, sheet, is_header from named""",
)
def sheet_of_line(spark, sf_dir):
    return _long(layout.sheet_of_line(fx(spark, sf_dir, "layout")).drop("row_in_sheet"), "line_no")


@check("row_in_sheet", "layout", f"{_SHEET_ROWS} select doc_id, i as line_no, row_in_sheet from named where not is_header")
def row_in_sheet(spark, sf_dir):
    rows = layout.sheet_of_line(fx(spark, sf_dir, "layout")).where("not is_header")
    return _long(rows.select("doc_id", "line_no", "row_in_sheet"), "line_no", "row_in_sheet")


@check(
    "export_cells",
    "layout",
    f"""{_SHEET_ROWS}, cells as (select doc_id, sheet_no, left(sheet, 31) as sheet, row_in_sheet as row_no, unnest(range(len(c))) + 1 as col_no,
            {duck.strip('unnest(c)')} as value
        from (select *, string_split(line, ' | ') as c from named where not is_header))
    select * from cells
    union all select doc_id, sheet_no, left(sheet, 31), null, null, null from named n where is_header
        and not exists (select 1 from named m where m.doc_id = n.doc_id and m.sheet_no = n.sheet_no and not m.is_header)
    union all select distinct doc_id, 1, 'Sheet1', null::bigint, null::bigint, null::varchar from layout where doc_id not in (select doc_id from nb)""",
)
def export_cells(spark, sf_dir):
    return _long(layout.export_cells(fx(spark, sf_dir, "layout")), "sheet_no", "row_no", "col_no")


# Table runs: consecutive lines with cells, from the first that is not header-like.
_BLOCKS = f""", {duck.lines('layout', 'l')},
    c as (select *, {duck.HEADER} as hd, contains(line, ' | ') as tb from l),
    isl as (select *, i - row_number() over (partition by doc_id, tb order by i) as island from c),
    run as (select *, tb and bool_or(not hd) over (partition by doc_id, tb, island order by i) as in_table from isl),
    starts as (select *, not (in_table and coalesce(lag(in_table) over (partition by doc_id order by i), false)) as opens from run),
    b as (select *, sum(opens::int) over (partition by doc_id order by i) - 1 as block_no,
        case when in_table then 'table' when hd then 'heading' when line = '' then 'empty' else 'paragraph' end as kind from starts),
    blocks as (select doc_id, block_no::bigint as block_no, kind, line,
        row_number() over (partition by doc_id, block_no order by i) - 1 as row_no from b)"""


@check(
    "export_blocks",
    "layout",
    f"""{_BLOCKS} select doc_id, block_no, kind, row_no, unnest(range(len(v))) as col_no, unnest(v) as value from (
        select *, case kind when 'table' then list_transform(string_split(line, ' | '), lambda x: {duck.strip('x')})
            when 'heading' then [{duck.SHEET_NAME}] else [line] end as v from blocks)""",
)
def export_blocks(spark, sf_dir):
    return _long(layout.export_blocks(fx(spark, sf_dir, "layout")), "block_no", "row_no", "col_no")


@check("table_islands", "layout", f"{_BLOCKS} select doc_id, block_no, row_no, line from blocks where kind = 'table'")
def table_islands(spark, sf_dir):
    return _long(layout.table_islands(fx(spark, sf_dir, "layout")), "block_no", "row_no")


@check(
    "table_width",
    "layout",
    f"""{_BLOCKS} select doc_id, block_no, count(*) as n_rows, max(len(string_split(line, ' | '))) as n_cols
    from blocks where kind = 'table' group by doc_id, block_no""",
)
def table_width(spark, sf_dir):
    return _long(layout.table_width(fx(spark, sf_dir, "layout")), "block_no", "n_rows", "n_cols")


_MD = f"""{_LINES},
    k as (select *, case when {duck.HEADER} then 'h' when contains(line, ' | ') then 't' else 'p' end as kind from nb),
    o as (select *, kind = 't' and coalesce(lag(kind) over (partition by doc_id order by n), '') <> 't' as opens_table from k)"""


@check("md_table_head", "layout", f"{_MD} select doc_id, n as ordinal, opens_table from o")
def md_table_head(spark, sf_dir):
    return _long(layout.md_table_head(fx(spark, sf_dir, "layout")), "ordinal")


@check(
    "export_markdown",
    "layout",
    f"""{_MD}, r as (select doc_id, string_agg(case kind when 'h' then '## ' || {duck.SHEET_NAME} || chr(10)
            when 't' then '| ' || line || ' |' || case when opens_table then
                chr(10) || '| ' || array_to_string(list_transform(string_split(line, ' | '), lambda x: '---'), ' | ') || ' |' else '' end
            else line || chr(10) end, chr(10) order by n) as body from o group by doc_id),
    m as (select doc_id, content, case when doc_id % 2 = 0 then 'Title ' || doc_id else '' end as title,
        case when doc_id % 3 = 0 then 'Author' end as author from layout)
    select m.doc_id, '---' || chr(10) || case when title <> '' then 'title: ' || title || chr(10) else '' end
        || case when author <> '' then 'author: ' || author || chr(10) else '' end
        || 'generated: 2024-05-06 07:08:09' || chr(10) || 'desensitized: true' || chr(10) || '---' || chr(10)
        || case when title <> '' then chr(10) || '# ' || title || chr(10) else '' end
        || case when body is null then '' else chr(10) || body end as markdown,
        coalesce(body, '') as plain
    from m left join r using (doc_id)""",
)
def export_markdown(spark, sf_dir):
    docs = fx(spark, sf_dir, "layout").selectExpr(
        "doc_id",
        "content",
        "if(doc_id % 2 = 0, concat('Title ', doc_id), '') as title",
        "if(doc_id % 3 = 0, 'Author', null) as author",
    )
    return docs.select(
        "doc_id",
        layout.export_markdown("content", "title", "author", "timestamp'2024-05-06 07:08:09'").alias("markdown"),
        layout.export_markdown("content").alias("plain"),
    )


# --- line helpers -----------------------------------------------------------------------


@check("strip_blank", "layout", f", {duck.lines('layout', 'l')} select distinct line from l")
def strip_blank(spark, sf_dir):
    lines = fx(spark, sf_dir, "layout").select(F.explode(F.split("content", "\n")).alias("raw"))
    return lines.select(T.strip_blank("raw").alias("line")).distinct()


@check("sheet_header_name", "layout", f"{_LINES} select doc_id, i as line_no, {duck.SHEET_NAME} as name from nb where {duck.HEADER}")
def sheet_header_name(spark, sf_dir):
    lines = explode_rows(fx(spark, sf_dir, "layout"), ["doc_id"], layout.stripped_lines("content"), "line_no", "line")
    headers = lines.where(T.is_sheet_header("line"))
    return _long(headers.select("doc_id", "line_no", T.sheet_header_name("line").alias("name")), "line_no")


@check(
    "split_cells",
    "layout",
    f"""{_LINES} select doc_id, i as line_no, unnest(range(len(c))) as cell_no, {duck.strip('unnest(c)')} as cell
    from (select *, string_split(line, ' | ') as c from nb)""",
)
def split_cells(spark, sf_dir):
    lines = explode_rows(fx(spark, sf_dir, "layout"), ["doc_id"], layout.stripped_lines("content"), "line_no", "line")
    cells = explode_rows(lines.where("line <> ''"), ["doc_id", "line_no"], T.split_cells("line"), "cell_no", "cell")
    return _long(cells, "line_no", "cell_no")


@check(
    "xml_sanitize",
    "",
    """select doc_id, regexp_replace(text || chr(1) || chr(9) || chr(31) || chr(13) || chr(11), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') as clean
    from documents""",
)
def xml_sanitize(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noisy = docs.select("doc_id", F.expr("concat(text, char(1), char(9), char(31), char(13), char(11))").alias("raw"))
    return noisy.select("doc_id", T.xml_sanitize("raw").alias("clean"))
