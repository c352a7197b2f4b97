"""Assembly of document texts from tables of pages, paragraphs and cells.

A document text is one cell in the end, but no document is ever gathered raw in one task:
rows are first put together by block (a range of pages or rows of one document), which
spreads a hot document over as many tasks as it has blocks, and then the blocks are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.constants import CELL_SEPARATOR, SHEET_PREFIX, SHEET_SUFFIX
from inkveil.functions.text import not_blank, strip_blank

#: Pages, paragraphs or table rows in one block.
BLOCK_ROWS = 256


def _block(ordinal: str) -> Column:
    return F.expr(f"`{ordinal}` div {BLOCK_ROWS}")


def joined(entries: Column, separator: str) -> Column:
    """Texts of ``array<struct<ordinal…, text>>`` in struct order, joined."""
    return F.array_join(F.transform(F.sort_array(entries), lambda x: x["text"]), separator)


def concat_agg(rows: DataFrame, keys: list[str], ordinal: str, value: str, separator: str) -> DataFrame:
    """Values per key in ordinal order, joined into ``text``; null values are left out."""
    entry = F.when(F.col(value).isNotNull(), F.struct(ordinal, F.col(value).alias("text")))
    blocks = (
        rows.groupBy(*keys, _block(ordinal).alias("_block"))
        .agg(F.collect_list(entry).alias("_rows"))
        .where(F.size("_rows") > 0)
        .select(*keys, "_block", joined(F.col("_rows"), separator).alias("text"))
    )
    parts = blocks.groupBy(*keys).agg(F.collect_list(F.struct("_block", "text")).alias("_parts"))
    return parts.select(*keys, joined(F.col("_parts"), separator).alias("text"))


def assemble_pages(pages: DataFrame, key: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """Document text of page rows (key, page_no, text).

    Blank pages are dropped from the text but counted. ``docs`` may list all documents, so
    that those without any page are reported too.
    """
    entry = F.when(not_blank("text"), F.struct("page_no", "text"))
    blocks = (
        pages.groupBy(key, _block("page_no").alias("_block"))
        .agg(F.count(F.lit(1)).alias("n"), F.collect_list(entry).alias("_rows"))
        .select(key, "_block", "n", F.when(F.size("_rows") > 0, joined(F.col("_rows"), "\n")).alias("text"))
    )
    part = F.when(F.col("text").isNotNull(), F.struct("_block", "text"))
    whole = (
        blocks.groupBy(key)
        .agg(F.sum("n").alias("page_count"), F.collect_list(part).alias("_parts"))
        .select(key, joined(F.col("_parts"), "\n").alias("content"), "page_count")
    )
    if docs is not None:
        whole = docs.select(key).join(whole, key, "left")
    code = F.when(F.col("page_count").isNull(), "EMPTY_DOCUMENT").when(F.col("content") == "", "NO_CONTENT")
    return whole.select(
        key,
        F.when(code.isNull(), F.col("content")).alias("content"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        code.alias("error_code"),
    )


def _cell_text(entries: Column) -> Column:
    """Cells of ``array<struct<row, col, text>>``: rows on lines, cells of a row separated."""
    order = F.sort_array(entries)

    def piece(xs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            same = F.get(xs, i - 1)["row"] == x["row"]
            lead = F.when(i == 0, "").when(same, CELL_SEPARATOR).otherwise("\n")
            return F.concat(lead, x["text"])

        return F.array_join(F.transform(xs, one), "")

    return F.get(F.transform(F.array(order), piece), F.lit(0))


def assemble_paragraphs_tables(paragraphs: DataFrame, cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document text of paragraph rows (key, para_no, text) and table cells
    (key, table_no, row_no, col_no, text).

    Paragraphs come first, as they are; then the tables, one line per row, cells stripped.
    Blank paragraphs and cells are left out. Without any text the error is the general one.
    """
    para = (
        paragraphs.groupBy(key, _block("para_no").alias("_block"))
        .agg(F.collect_list(F.when(not_blank("text"), F.struct("para_no", "text"))).alias("_rows"))
        .select(key, F.lit(-1).cast("long").alias("part"), "_block", F.when(F.size("_rows") > 0, joined(F.col("_rows"), "\n")).alias("text"))
    )
    cell = F.struct(F.col("row_no").alias("row"), F.col("col_no").alias("col"), strip_blank("text").alias("text"))
    table = (
        cells.groupBy(key, F.col("table_no").cast("long").alias("part"), _block("row_no").alias("_block"))
        .agg(F.collect_list(F.when(not_blank("text"), cell)).alias("_rows"))
        .select(key, "part", "_block", F.when(F.size("_rows") > 0, _cell_text(F.col("_rows"))).alias("text"))
    )
    entry = F.when(F.col("text").isNotNull(), F.struct("part", "_block", "text"))
    whole = para.unionByName(table).groupBy(key).agg(F.collect_list(entry).alias("_parts"))
    content = joined(F.col("_parts"), "\n")
    code = F.when(F.size("_parts") == 0, "PARSING_FAILED")
    return whole.select(key, F.when(code.isNull(), content).alias("content"), code.alias("error_code"))


def sheet_header(name: Column) -> Column:
    return F.concat(F.lit(SHEET_PREFIX + " "), name, F.lit(" " + SHEET_SUFFIX))


def assemble_sheets(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document text of sheet cells (key, sheet_ix, sheet_name, row_ix, col_ix, value).

    Every sheet with a non-blank cell gives a header line and a line per row with one; cell
    texts stay as they are. Sheets without one are counted only.
    """
    cell = F.struct(F.col("row_ix").alias("row"), F.col("col_ix").alias("col"), F.col("value").alias("text"))
    blocks = (
        cells.groupBy(key, "sheet_ix", _block("row_ix").alias("_block"))
        .agg(
            F.min("sheet_name").alias("sheet_name"),
            F.collect_list(F.when(not_blank("value"), cell)).alias("_rows"),
        )
        .select(
            key,
            "sheet_ix",
            "_block",
            "sheet_name",
            F.size("_rows").alias("n"),
            F.when(F.size("_rows") > 0, _cell_text(F.col("_rows"))).alias("text"),
        )
    )
    part = F.when(F.col("text").isNotNull(), F.struct("sheet_ix", "_block", "sheet_name", "text"))
    whole = blocks.groupBy(key).agg(
        F.collect_list(part).alias("_parts"),
        # A distinct count would group and move the texts once more.
        F.size(F.collect_set("sheet_ix")).cast("long").alias("sheet_count"),
        F.sum("n").alias("non_empty_cells"),
    )

    def with_headers(xs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            opens = F.coalesce(F.get(xs, i - 1)["sheet_ix"] != x["sheet_ix"], F.lit(True))
            return F.when(opens, F.concat(sheet_header(x["sheet_name"]), F.lit("\n"), x["text"])).otherwise(x["text"])

        return F.array_join(F.transform(xs, one), "\n")

    content = F.get(F.transform(F.array(F.sort_array("_parts")), with_headers), F.lit(0))
    code = F.when(F.col("non_empty_cells") == 0, "PARSING_FAILED")
    return whole.select(
        key,
        F.when(code.isNull(), content).alias("content"),
        "sheet_count",
        "non_empty_cells",
        code.alias("error_code"),
    )


def sheet_info(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Name, rows and columns of every sheet that is kept in the text."""
    return (
        cells.groupBy(key, "sheet_ix")
        .agg(
            F.min("sheet_name").alias("name"),
            F.max("row_ix").alias("rows"),
            F.max("col_ix").alias("columns"),
            F.count_if(not_blank("value")).alias("_filled"),
        )
        .where("_filled > 0")
        .drop("_filled")
    )


def non_empty_cells(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    return cells.groupBy(key).agg(F.count_if(not_blank("value")).alias("non_empty_cells"))


def doc_structure(
    pages: DataFrame, paragraphs: DataFrame, table_cells: DataFrame, sheet_cells: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Pages, paragraphs, tables and sheets per document, blank ones included.

    Each table is counted on its own (combined before its shuffle); only counts are joined.
    """
    counts = [
        pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages")),
        paragraphs.groupBy(key).agg(F.count(F.lit(1)).alias("paragraphs")),
        table_cells.groupBy(key).agg(F.count_distinct("table_no").alias("tables")),
        sheet_cells.groupBy(key).agg(F.count_distinct("sheet_ix").alias("sheets")),
    ]
    names = ["pages", "paragraphs", "tables", "sheets"]
    wide = None
    for df, name in zip(counts, names):
        padded = df.select(key, *[F.col(n) if n == name else F.lit(0).cast("long").alias(n) for n in names])
        wide = padded if wide is None else wide.unionByName(padded)
    return wide.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
