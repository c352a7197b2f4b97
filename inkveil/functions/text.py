"""String, path, time, JSON and map expressions."""

from __future__ import annotations

from pyspark.sql import Column

from inkveil.constants import (
    CELL_SEPARATOR,
    CENSORED,
    CENSORED_KEYS,
    OUTPUT_SUFFIX,
    SHEET_PREFIX,
    SHEET_SUFFIX,
)
from inkveil.functions import sql as F
from inkveil.functions.sql import Expr, expression

# The characters Unicode counts as white space; Spark's trim() alone knows only
# the space.
_BLANKS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


@expression
def strip_blank(value: Expr) -> Expr:
    """``value`` without leading and trailing white space."""
    return F.btrim(value, _BLANKS)


@expression
def not_blank(value: Expr) -> Expr:
    """Whether anything but white space is in ``value``; false for null."""
    return F.coalesce(value.rlike(r"(?U)[^\s\x1c-\x1f]"), False)


@expression
def line_count(text: Expr) -> Expr:
    """Number of lines, a trailing line break ending the last one."""
    open_end = (F.length(text) > 0) & ~text.rlike(rf"(?:{_LINE_BREAK})\z")
    return F.regexp_count(text, _LINE_BREAK) + open_end.cast("int")


@expression
def file_ext(name: Expr) -> Expr:
    """Lower-case extension with its dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^/.]*)\z", 1))


@expression
def file_type_of(ext: Expr) -> Expr:
    """File type of an extension."""
    return F.substr(ext, 2, F.length(ext))


@expression
def is_sheet_header(line: Expr) -> Expr:
    """Whether a stripped line is a sheet header."""
    return line.startswith(SHEET_PREFIX) & line.endswith(SHEET_SUFFIX)


@expression
def sheet_header_name(line: Expr) -> Expr:
    """Sheet name of a header line: both markers removed wherever they occur, then stripped."""
    bare = F.replace(F.replace(line, SHEET_PREFIX, ""), SHEET_SUFFIX, "")
    return strip_blank(bare)


@expression
def is_table_line(line: Expr) -> Expr:
    """Whether a stripped line holds table cells."""
    return line.contains(CELL_SEPARATOR)


@expression
def split_cells(line: Expr) -> Expr:
    """Cells of a table line, each stripped."""
    return F.transform(F.split(line, r" \| ", -1), strip_blank)


@expression
def xml_sanitize(text: Expr) -> Expr:
    """``text`` without the control characters XML forbids; tab, LF and CR stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


@expression
def stamp(ts: Expr) -> Expr:
    """Compact time stamp of exported file names."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


@expression
def generated_stamp(ts: Expr) -> Expr:
    """Time stamp of the Markdown front matter."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


@expression
def iso_stamp(ts: Expr) -> Expr:
    """ISO-8601 time stamp; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, ".", micros))


@expression
def export_filename(name: Expr, fmt: Expr, ts: Expr) -> Expr:
    """Name of an exported file; the base name is cut at the last dot."""
    base = F.regexp_replace(name, r"\.[^.]*\z", "")
    return F.concat(base, f"{OUTPUT_SUFFIX}_", stamp(ts), ".", fmt)


@expression
def output_path(path: Expr, base_dir: str, out_dir: str) -> Expr:
    """Target of a processed file: suffix on the stem, folders below ``base_dir`` kept.

    A path outside ``base_dir`` goes to the top of ``out_dir``.
    """
    base = base_dir.rstrip("/") + "/"
    below = F.when(path.startswith(base), F.substr(path, len(base) + 1, F.length(path)))
    relative = F.coalesce(below, F.substring_index(path, "/", -1))
    name = F.substring_index(relative, "/", -1)
    folder = F.substr(relative, 1, F.length(relative) - F.length(name))
    stem = F.regexp_extract(name, r"(?s)\A(.+)(\.[^.]+)\z", 1)
    suffix = F.regexp_extract(name, r"(?s)\A(.+)(\.[^.]+)\z", 2)
    new_name = F.concat(F.when(stem == "", name).otherwise(stem), OUTPUT_SUFFIX, suffix)
    return F.concat(out_dir.rstrip("/") + "/", folder, new_name)


@expression
def metadata_get(metadata: Expr, key: str) -> Expr:
    """Entry of a metadata map, empty when absent."""
    return F.coalesce(F.element_at(metadata, key), "")


def details_json(**fields: str) -> Column:
    """Details object of an audit row from SQL expressions, keys in the given order."""
    return F.to_json(F.struct(*[Expr(value, name) for name, value in fields.items()])).column


@expression
def details_get(details: Expr, key: str) -> Expr:
    """One value of a details object, as text."""
    return F.get_json_object(details, f"$.{key}")


@expression
def censor_map(entries: Expr) -> Expr:
    """Map with the values of sensitive keys blanked; keys are tested by containment."""
    words = F.array(*CENSORED_KEYS)
    return F.transform_values(
        entries,
        lambda k, v: F.when(F.exists(words, lambda w: F.lower(k).contains(w)), CENSORED).otherwise(v),
    )


@expression
def error_row(code: Expr, message: Expr, details: Expr) -> Expr:
    """The (code, message, details) triple of a failure, null when there is no code."""
    return F.when(
        code.isNotNull(),
        F.struct(code.alias("error_code"), message.alias("message"), details.alias("details")),
    )
