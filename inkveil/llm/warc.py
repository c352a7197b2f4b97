"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Writing: of records with equal payloads of at least ``least`` bytes, the one with the largest id becomes a
``response``; the others become ``revisit`` records that refer to it and carry its digest and length only.
Records are written by Spark's text writer, whose line separator is the blank lines that end a record; so
archives reach any store Spark writes to, and a lost task leaves none behind. Payloads are not shuffled
unless the payloads that occur more than once are too many to broadcast.

Reading: every file is walked from record to record, plain or in gzip members, one record or many to a
member. A record must have a version line, headers, a block of the stated length, the blank lines after it,
and the digest that it states. Where a check fails, the reader looks for the next version line or gzip
member from which a record passes all checks, goes on there, and reports the bytes between as a gap with
the reason; of a damaged member the records before the damage are recovered.

Defined cases: a null payload is empty; a null url has no target; a null id is written without one, never
wins over an id, and reads back as null; where all copies have null ids, and for rows that share the largest
id, each is a response; repeated rows are written as often as they come; an empty table gives no
records; other columns are ignored. A file has to fit the 2 GB of a cell, so the writer limits its files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.shared import small, stored

#: Payloads below this size are always written.
LEAST_REVISIT = 1000
#: Bytes that a file of the writer has, about, and what it never exceeds by more than a record.
FILE_BYTES = 32 << 20
FILE_LIMIT = 1 << 30
#: The records' date; a parameter, so that a repeated run writes the same bytes.
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOUND = (
    "path string, kind string, offset long, length long, reason string, record_type string, record_id string, "
    "refers_to string, page string, uri string, payload_digest string, payload_bytes long, payload binary"
)
_VERSION, _GZIP, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
#: Version lines before one end of headers that are tried, from the first and from the last.
TRIES = 8


def _record_id(page: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _headers(*pairs: tuple[str, Column]) -> Column:
    """Header lines; those whose value is null are left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in pairs))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = LEAST_REVISIT,
    date: str = DATE,
) -> None:
    """Writes one record per row of ``pages`` to archives in the folder ``path``."""
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"size": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary"))})
    light = stored(rows.select("id", "size", "digest"), "warc-digests")
    shared = (
        light.where(F.col("size") >= least)
        .groupBy(F.col("digest").alias("of_digest"), F.col("size").alias("of_size"))
        .agg(F.max("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .drop("n")
    )
    shared = stored(shared, "warc-shared")
    sizes = light.agg(F.max("size"), F.avg("size")).first()
    largest, mean = (sizes[0] or 0) + 4096, (sizes[1] or 0) + 1024
    per_file = max(1, int(min(FILE_BYTES / mean, FILE_LIMIT / largest)))

    same = (F.col("digest") == F.col("of_digest")) & (F.col("size") == F.col("of_size"))
    told = rows.join(small(shared, row_bytes=128), same, "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"),
        _headers(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("size"))),
        F.lit("\r\n"),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = _headers(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", clean),
        ("WARC-Page-ID", F.col("id")),
        ("WARC-Payload-Digest", digest),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.col("first"), F.col("digest")))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))),
    )
    record = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block).alias("value")
    told.select(record).write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)


class Damaged(Exception):
    """Why a record fails its checks."""


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n"))
    return {name.strip().lower().decode("latin-1"): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


def _number(value: str | None) -> int | None:
    """A number of up to 18 digits; more of them are no size of anything."""
    digits = (value or "").lstrip("0") or (value or "")[:1]
    return int(digits) if digits.isascii() and digits.isdigit() and len(digits) <= 18 else None


def parse_record(data: bytes, at: int, head_end: int) -> tuple[dict, int]:
    """The record that starts at ``at``, with its headers up to ``head_end``, and the offset after it; raises ``Damaged``."""
    if head_end >= len(data):
        raise Damaged("headers do not end")
    first, _, lines = data[at:head_end].partition(b"\r\n")
    if not first[len(_VERSION) :].isdigit():
        raise Damaged("no version line")
    fields = _fields(lines)
    length, start = _number(fields.get("content-length")), head_end + 4
    if length is None:
        raise Damaged("no content length")
    end = start + length
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end as stated")
    block, kind = data[start:end], fields.get("warc-type")
    size, payload = length, block
    if fields.get("content-type", "").startswith("application/http"):
        http_end = block.find(b"\r\n\r\n")
        if http_end < 0:
            raise Damaged("http headers do not end")
        payload = block[http_end + 4 :]
        size = len(payload)
        if kind == "revisit":
            size = _number(_fields(block[:http_end]).get("content-length"))
    algorithm, _, stated = fields.get("warc-payload-digest", "").partition(":")
    digest = None
    if kind != "revisit":
        digest = hashlib.sha1(payload).hexdigest()
    if algorithm.lower() == "sha1":
        try:
            stated = stated.lower() if len(stated) == 40 else base64.b32decode(stated).hex()
        except ValueError:
            raise Damaged("digest cannot be read") from None
        if digest is not None and digest != stated:
            raise Damaged("digest differs")
        digest = stated
    record = {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"),
        "page": fields.get("warc-page-id"), "uri": fields.get("warc-target-uri"), "payload_digest": digest,
        "payload_bytes": size, "payload": payload,
    }
    return record, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, int]:
    """What the gzip member at ``at`` holds, its end, or None if it is damaged or cut off, and how far it was read."""
    wheel, out, place = zlib.decompressobj(31), [], at
    step = 512  # what only looks like a member fails soon
    while not wheel.eof and place < len(data):
        piece, before, step = data[place : place + step], wheel.copy(), 65536
        try:
            out.append(wheel.decompress(piece))
        except zlib.error:
            # what a failing call has made is lost: again byte by byte, up to the one with the error
            try:
                for i in range(len(piece)):
                    place += 1
                    out.append(before.decompress(piece[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), None, place
        place += len(piece)
    return b"".join(out), place - len(wheel.unused_data) if wheel.eof else None, place


class Marks:
    """Where marks follow next, for positions that only grow: the data is searched once for each."""

    def __init__(self, data: bytes):
        self.data = data
        self.found: dict[bytes, int] = {}

    def following(self, mark: bytes, at: int) -> int:
        place = self.found.get(mark, -1)
        if place < at:
            place = self.data.find(mark, at)
            self.found[mark] = place = len(self.data) if place < 0 else place
        return place


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[str, int, int, object]]:
    """('record', offset, length, fields) and ('gap', offset, length, reason), in the order of the bytes.

    Records of a gzip member have the member's offset and length; inside there are no further members. Of many
    version lines before the same end of headers the first and the last ``TRIES`` are tried, so that work stays in
    proportion to the bytes.
    """
    marks, tried, last_tried = Marks(data), [-1, 0], 0

    def next_start(at: int) -> int:
        return min(marks.following(_VERSION, at), marks.following(_GZIP, at) if members else len(data))

    def worth_trying(at: int, head_end: int) -> bool:
        nonlocal last_tried
        tried[:] = [head_end, tried[1] + 1 if tried[0] == head_end else 1]
        if tried[1] == TRIES + 1:
            last_tried = head_end
            for _ in range(TRIES):
                last_tried = max(data.rfind(_VERSION, at, last_tried), at)
        return tried[1] <= TRIES or at >= last_tried

    at, bad, reason = 0, None, ""
    known, reach = [], 0  # what damaged members gave, and how far they were read: stored blocks show it again

    def gap(end: int):
        if bad is not None and end > bad:
            yield "gap", bad, end - bad, reason

    while at < len(data):
        if members and data.startswith(_GZIP, at):
            inner, end, read = _inflate(data, at)
            found = list(salvage(inner, members=False))
            records = [f for kind, _, _, f in found if kind == "record"]
            if end is not None and records:
                yield from gap(at)
                bad = None
                yield from (("record", at, end - at, f) for f in records)
                lost = [f for kind, _, _, f in found if kind == "gap"]
                if lost:
                    yield "gap", at, end - at, f"in member: {lost[0]}"
                at = end
                continue
            if records:  # the records before the damage
                yield from gap(at)
                bad = None
                yield from (("record", at, 0, f) for f in records)
                known, reach = (known if at < reach else []) + records, max(reach, read)
            if bad is None:
                bad, reason = at, "gzip member is damaged" if end is None else "gzip member holds no record"
            at = next_start(at + 1) if end is None else end
            continue
        if data.startswith(_VERSION, at):
            head_end = marks.following(END, at)
            try:
                if not worth_trying(at, head_end):
                    raise Damaged("one of many version lines")
                record, end = parse_record(data, at, head_end)
            except Damaged as why:
                if bad is None:
                    bad, reason = at, str(why)
            else:
                if at < reach and record in known:
                    known.remove(record)
                    at = end
                    continue
                yield from gap(at)
                bad = None
                yield "record", at, end - at, record
                at = end
                continue
        elif bad is None:
            bad, reason = at, "no record starts here"
        at = next_start(at + 1)
    yield from gap(len(data))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps (``kind``) of all archives in the folder ``path``; payloads only if asked for."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], FOUND).schema)
    blank = dict.fromkeys(schema.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for kind, offset, length, what in salvage(content.as_py()):
                    row = blank | {"path": name.as_py(), "kind": kind, "offset": offset, "length": length}
                    row |= what if kind == "record" else {"reason": what}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(walk, FOUND)


def stored_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records, without payloads, and the gaps of all archives in the folder ``path``, each a stored table."""
    found = stored(read_archives(spark, path).drop("payload"), "warc-records")
    gaps = stored(found.where("kind = 'gap'").select("path", "offset", "length", "reason"), "warc-gaps")
    return found.where("kind = 'record'"), gaps


def resolved(records: DataFrame) -> DataFrame:
    """The records with ``refers_page``: for revisits the page of the response they refer to, if it was read."""
    responses = (
        records.where("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.first("page").alias("refers_page"))
    )
    return records.join(responses, F.col("refers_to") == F.col("target"), "left").drop("target")
