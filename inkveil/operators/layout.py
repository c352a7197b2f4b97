"""Reading layout text back: sheets, tables, Markdown.

The text of a document is one cell, and its lines are worked on within the row: each line
becomes one letter, and runs of letters found by a regex are the sheets and tables. No
window over the lines, and so no shuffle of the texts, is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.constants import CELL_SEPARATOR, DEFAULT_SHEET, SHEET_TITLE_LIMIT
from inkveil.functions import sql as X
from inkveil.functions.arrays import add, empty, let, running
from inkveil.functions.sql import Expr, expression
from inkveil.functions.text import (
    generated_stamp,
    is_sheet_header,
    is_table_line,
    sheet_header_name,
    split_cells,
    strip_blank,
)
from inkveil.operators.rows import explode_rows


@expression
def stripped_lines(content: Expr) -> Expr:
    return X.transform(X.split(content, "\n", -1), lambda x: strip_blank(x))


def _filled(lines: Expr) -> Expr:
    return X.filter(lines, lambda x: x != "")


def _runs(lines: Expr, letter, regex: str) -> Expr:
    """Runs of lines whose letters match ``regex``, as ``struct<value, start_pos, n>``.

    The regex has to match every letter, so the runs lie end to end.
    """
    letters = X.array_join(X.transform(lines, lambda x: letter(x)), "")

    def place(found: Expr) -> Expr:
        before = running(X.transform(found, lambda v: X.length(v)), add)
        return X.zip_with(
            found,
            before,
            lambda v, at: X.struct(v.alias("value"), at.alias("start_pos"), X.length(v).alias("n")),
        )

    return let(X.regexp_extract_all(letters, regex, 0), place)


def _inside(lines: Expr, run: Expr) -> Expr:
    return X.slice(lines, run["start_pos"] + 1, run["n"])


# --- sheets -----------------------------------------------------------------------------


def _sheet_letter(line: Expr) -> Expr:
    return X.when(is_sheet_header(line), "H").otherwise("r")


def _by_sheet(lines: Expr) -> Expr:
    """``array<struct<headed, name, part>>``: numbered lines ``struct<line, i>`` by sheet.

    A sheet begins at its header; lines before any header form one of the default name.
    """

    def sheet(run: Expr) -> Expr:
        headed = run["value"].startswith("H")
        name = sheet_header_name(X.get(lines, run["start_pos"])["line"])
        return X.struct(
            headed.alias("headed"),
            X.when(headed, name).otherwise(DEFAULT_SHEET).alias("name"),
            _inside(lines, run).alias("part"),
        )

    return X.transform(_runs(lines, lambda x: _sheet_letter(x["line"]), "Hr*|r+"), sheet)


def _sheets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sheets) with the non-blank lines of each text by sheet."""
    numbered = X.transform(
        X.split(Expr(text), "\n", -1), lambda x, i: X.struct(strip_blank(x).alias("line"), i.alias("i"))
    )
    return docs.select(key, let(X.filter(numbered, lambda x: x["line"] != ""), _by_sheet).column.alias("sheets"))


def export_cells(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, sheet_no, sheet, row_no, col_no, value): the cells of a workbook export.

    Blank lines are skipped without advancing the row; lines before any header go to a
    default sheet; a sheet without rows gives one row with null row, column and value.
    Sheets are numbered from 1, since names may repeat.
    """
    one = _sheets(docs, key, text).select(key, F.posexplode_outer("sheets").alias("n", "s"))
    body = F.expr("if(s.headed, slice(s.part, 2, size(s.part)), s.part)")
    rows = one.select(
        key,
        (F.coalesce("n", F.lit(0)) + 1).alias("sheet_no"),
        F.left(F.coalesce("s.name", F.lit(DEFAULT_SHEET)), F.lit(SHEET_TITLE_LIMIT)).alias("sheet"),
        F.posexplode_outer(body).alias("r", "x"),
    )
    cells = rows.select(
        key, "sheet_no", "sheet", (F.col("r") + 1).alias("row_no"), F.posexplode_outer(split_cells("x.line")).alias("c", "value")
    )
    return cells.select(key, "sheet_no", "sheet", "row_no", (F.col("c") + 1).alias("col_no"), "value")


def sheet_of_line(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, line_no, sheet, is_header, row_in_sheet) of every non-blank line.

    ``line_no`` counts all lines from 0; ``row_in_sheet`` counts the non-blank lines of the
    sheet from 1 and is 0 on its header. Lines before any header have the default sheet.
    """
    one = explode_rows(_sheets(docs, key, text), [key], "sheets", "n", "s")
    lines = explode_rows(one, [key, "s.name", "s.headed"], "s.part", "j", "x")
    row = F.col("j") + 1 - F.col("headed").cast("int")
    return lines.select(
        key, F.col("x.i").alias("line_no"), F.col("name").alias("sheet"), (row == 0).alias("is_header"), row.alias("row_in_sheet")
    )


# --- blocks -----------------------------------------------------------------------------

_KINDS = {"H": "heading", "P": "heading", "T": "table", "E": "empty", "x": "paragraph"}


def _block_letter(line: Expr) -> Expr:
    header, table = is_sheet_header(line), is_table_line(line)
    return X.when(line == "", "E").when(header & table, "P").when(header, "H").when(table, "T").otherwise("x")


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, kind, lines). A header-like line with cells belongs to a table that
    is open, and is a heading otherwise; blank lines are blocks and close a table."""
    kinds = X.map(*[x for pair in _KINDS.items() for x in pair])

    def cut(lines: Expr) -> Expr:
        def block(run: Expr) -> Expr:
            kind = X.element_at(kinds, X.left(run["value"], 1))
            return X.struct(kind.alias("kind"), _inside(lines, run).alias("lines"))

        return X.transform(_runs(lines, _block_letter, "T[TP]*|[HPEx]"), block)

    blocks = let(stripped_lines(Expr(text)), cut).column
    return explode_rows(docs, [key], blocks, "block_no", "b").select(key, "block_no", "b.kind", "b.lines")


def export_blocks(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, block_no, kind, row_no, col_no, value): the content of a word-processor export.

    Kinds are heading, table, paragraph and empty; rows and columns count from 0.
    """
    rows = explode_rows(_blocks(docs, key, text), [key, "block_no", "kind"], "lines", "row_no", "line")
    cells = (
        F.when(F.col("kind") == "table", split_cells("line"))
        .when(F.col("kind") == "heading", F.array(sheet_header_name("line")))
        .otherwise(F.array("line"))
    )
    return explode_rows(rows, [key, "block_no", "kind", "row_no"], cells, "col_no", "value")


def table_islands(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, block_no, row_no, line) of the runs of consecutive table lines."""
    tables = _blocks(docs, key, text).where("kind = 'table'")
    return explode_rows(tables, [key, "block_no"], "lines", "row_no", "line")


def table_width(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, block_no, n_rows, n_cols) of the tables; the widest row counts."""
    tables = _blocks(docs, key, text).where("kind = 'table'")
    widths = X.transform(X.col("lines"), lambda x: X.size(split_cells(x))).column
    return tables.select(key, "block_no", F.size("lines").alias("n_rows"), F.array_max(widths).alias("n_cols"))


# --- Markdown ---------------------------------------------------------------------------


def _opens_table(lines: Expr, line: Expr, i: Expr) -> Expr:
    """Whether a line starts a table: cells here, and no table line before it."""

    def plain(x: Expr) -> Expr:
        return is_table_line(x) & ~is_sheet_header(x)

    return plain(line) & ~X.coalesce(plain(X.get(lines, i - 1)), False)


def md_table_head(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, ordinal, opens_table) of every non-blank line."""
    flags = let(_filled(stripped_lines(Expr(text))), lambda xs: X.transform(xs, lambda x, i: _opens_table(xs, x, i)))
    return explode_rows(docs, [key], flags.column, "ordinal", "opens_table")


def _if_given(value: Expr, *rendered: Expr | str) -> Expr:
    """The rendered lines if ``value`` is neither null nor empty."""
    return X.when(value != "", X.array(*rendered)).otherwise(empty("string"))


def _front_matter(title: Expr, author: Expr, generated: Expr) -> Expr:
    return X.concat(
        X.array("---"),
        _if_given(title, X.concat("title: ", title)),
        _if_given(author, X.concat("author: ", author)),
        X.array(X.concat("generated: ", generated_stamp(generated)), "desensitized: true", "---", ""),
    )


@expression
def export_markdown(
    content: Expr, title: Expr | None = None, author: Expr | None = None, generated: Expr | None = None
) -> Expr:
    """Layout text as Markdown.

    With ``generated`` given (a document with metadata) a front matter comes first. Sheet
    headers become headings, table lines get bars, the first of a table a separator line;
    blank lines are dropped and do not end a table.
    """
    title = X.lit("") if title is None else title
    author = X.lit("") if author is None else author

    def body(lines: Expr) -> Expr:
        def render(line: Expr, i: Expr) -> Expr:
            bar = X.concat("| ", line, " |")
            dashes = X.array_repeat("---", X.size(split_cells(line)))
            rule = X.concat("| ", X.array_join(dashes, CELL_SEPARATOR), " |")
            return (
                X.when(is_sheet_header(line), X.array(X.concat("## ", sheet_header_name(line)), ""))
                .when(_opens_table(lines, line, i), X.array(bar, rule))
                .when(is_table_line(line), X.array(bar))
                .otherwise(X.array(line, ""))
            )

        return X.flatten(X.transform(lines, render))

    parts = [_if_given(title, X.concat("# ", title), ""), let(_filled(stripped_lines(content)), body)]
    if generated is not None:
        parts.insert(0, _front_matter(title, author, generated))
    return X.array_join(X.concat(*parts), "\n")
