"""Files as tables: scanning, intake checks, decoding."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.constants import (
    ALLOWED_EXTENSIONS,
    FALLBACK_ENCODINGS,
    MAX_FILE_SIZE,
    PARSED_TYPES,
)
from inkveil.functions.text import file_ext, file_type_of, line_count, not_blank
from inkveil.sources.encodings import CONTROL, EncodingModel
from inkveil.sources.sinks import shared_folder

#: Schema of Spark's binary file source, needed by name for streams.
BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


#: Types whose contents are decoded here; files of other types are listed without being read.
READ_EXTENSIONS = [".txt", ".md"]


def file_contents(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """(path, ext, length, content) of binary files; with ``max_size``, content is null beyond it.

    The size test reaches the scan, so that a file too large to be accepted is listed without being read.
    """
    named = files.withColumn("ext", file_ext("path"))
    if max_size is None:
        return named.select("path", "ext", "length", "content")
    read = named.where(F.col("length") <= max_size).select("path", "ext", "length", "content")
    listed = named.where(F.col("length") > max_size)
    return read.unionByName(listed.select("path", "ext", "length", F.lit(None).cast("binary").alias("content")))


def any_case_glob(extensions: list[str]) -> str:
    """A file-name pattern for the extensions in any case."""
    letters = ("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in extensions)
    return f"*{{{','.join(letters)}}}"


def opened(uri: str):
    """A file system and the path in it; local paths are taken as they are written."""
    from pyarrow import fs

    local = re.match(r"\Afile:/+", uri)
    if local or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri[local.end() :] if local else uri
    return fs.FileSystem.from_uri(uri)


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over as well."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below ``folder``, empty ones too, as Spark's readers name them.

    Folders are listed by tasks, one level of the tree after the other, so no listing passes through the
    driver. Stores are opened by pyarrow in the tasks: local and mounted folders, S3, GCS and HDFS.
    """
    root = qualified(spark, folder)
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_())])
    scheme = "" if root.startswith("file:") else root.split("://")[0] + "://"
    store = root if scheme else "file:/"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = opened(store)[0]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = [i for i in system.get_file_info(fs.FileSelector(path)) if not _hidden(i.base_name)]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    folders = [i.type == fs.FileType.Directory for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.path for i in some]), pa.array([i.size for i in some], pa.int64()), pa.array(folders)], schema=schema
                    )

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, level = None, spark.range(1).select(F.lit(opened(root)[1].rstrip("/") or "/").alias("path"))
    while True:
        target = shared_folder(spark, "listing")
        level.repartition(tasks, "path").mapInArrow(listed, "path string, length long, is_folder boolean").write.parquet(target)
        found = spark.read.schema("path string, length long, is_folder boolean").parquet(target)
        own = found.where("not is_folder").select(F.concat(F.lit(scheme or "file:"), "path").alias("path"), "length")
        files = own if files is None else files.unionByName(own)
        level = found.where("is_folder").select("path")
        if level.isEmpty():
            return files


def read_files(spark: SparkSession, folder: str, max_size: int | None = None) -> DataFrame:
    """What ``scan_files`` gives, for folders of very many files: tasks list them, and tasks read them.

    Spark's file sources keep the name of every file on the driver; here none passes through it.
    """
    root = qualified(spark, folder)
    prefix = "file:" if root.startswith("file:") else root.split("://")[0] + "://"
    schema = pa.schema([("path", pa.string()), ("ext", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, rows, held = opened(root)[0], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                row["content"] = None
                if row["ext"] in READ_EXTENSIONS and (max_size is None or row["length"] <= max_size):
                    with system.open_input_stream(row["path"][len(prefix) :]) as stream:
                        row["content"] = stream.read()
                rows.append(row)
                held += row["length"] if row["content"] is not None else 0
                if held > 16 << 20 or len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = list_files(spark, folder).withColumn("ext", file_ext("path")).where(F.col("ext").isin(ALLOWED_EXTENSIONS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.select("path", "ext", "length").repartition(tasks, "path")
    return dealt.mapInArrow(read, "path string, ext string, length long, content binary")


def scan_files(spark: SparkSession, folder: str, max_size: int | None = None, empty: bool = True) -> DataFrame:
    """(path, ext, length, content) of the supported files below ``folder``.

    Only files of ``READ_EXTENSIONS`` are read; the others are listed with null content. Spark's readers pass
    over files of zero bytes; with ``empty`` they are added from ``list_files``. ``read_files`` gives the same without
    a listing on the driver.
    """

    def source(extensions: list[str]) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        return reader.option("pathGlobFilter", any_case_glob(extensions)).load(folder)

    others = [ext for ext in ALLOWED_EXTENSIONS if ext not in READ_EXTENSIONS]
    blank = F.lit(None).cast("binary").alias("content")
    found = file_contents(source(READ_EXTENSIONS), max_size)
    listed = source(others).withColumn("ext", file_ext("path")).select("path", "ext", "length", blank)
    files = found.unionByName(listed)
    if empty:
        zero = list_files(spark, folder).where("length = 0").withColumn("ext", file_ext("path"))
        zero = zero.where(F.col("ext").isin(ALLOWED_EXTENSIONS))
        files = files.unionByName(zero.select("path", "ext", "length", F.lit(b"").alias("content")))
    return files


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as Spark's readers name it: with its scheme, and absolute."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def intake_code(ext: Column, size: Column, max_size: int | None = MAX_FILE_SIZE) -> Column:
    """Why a file is refused, null if it is accepted; the extension is tested first."""
    code = F.when(~ext.isin(ALLOWED_EXTENSIONS), "UNSUPPORTED_FORMAT")
    return code if max_size is None else code.when(size > max_size, "FILE_SIZE_EXCEEDED")


def validate_intake(files: DataFrame, name: str = "filename", size: str = "size") -> DataFrame:
    """``files`` with ext and reject_code."""
    return files.withColumn("ext", file_ext(name)).withColumn("reject_code", intake_code(F.col("ext"), F.col(size)))


def register_task(accepted: DataFrame, at: Column, upload: Column | None = None) -> DataFrame:
    """Task rows of accepted files (filename, size, ext), with status ``uploaded``.

    The id is derived instead of drawn, so a retried task writes the same: from name, size, time and
    ``upload``, a key of the upload such as its ordinal in a manifest. Without one, uploads that share a name
    are numbered.
    """
    rows = accepted.select("filename", "size", "ext", at.alias("_at"), *([] if upload is None else [upload.alias("_upload")]))
    if upload is None:
        same = ["filename", "size", "ext", "_at"]
        # copies are counted where they are; only the counts of a name meet, and its numbers are dealt out again
        counts = rows.withColumn("_part", F.spark_partition_id()).groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        first = F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1
        dealt = counts.withColumn("_first", first).repartition("filename", "_part")
        rows = dealt.withColumn("_upload", F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)))
    return rows.select(
        F.sha2(F.concat_ws("\u0001", "filename", F.col("size").cast("string"), F.col("_at").cast("string"), F.col("_upload").cast("string")), 256).alias("id"),
        "filename",
        F.col("size").cast("bigint").alias("file_size"),
        file_type_of("ext").alias("file_type"),
        F.col("_at").alias("upload_time"),
        F.lit("uploaded").alias("status"),
    )


def parse_route(file_type: Column, strict: bool = False) -> Column:
    """The reader of a file type, or the error code ``UNSUPPORTED_FORMAT``.

    ``md`` passes intake but has no reader of its own: it is refused when ``strict``, and
    read as plain text otherwise.
    """
    kind = F.lower(file_type)
    route = F.when(kind.isin(PARSED_TYPES), kind)
    if not strict:
        route = route.when(kind == "md", "txt")
    return route.otherwise("UNSUPPORTED_FORMAT")


def _foreign_decoder(shared: Broadcast | None):
    """Arrow UDF for the byte strings that are not UTF-8; the others arrive as null.

    A byte order mark decides. Else a model's likeliest reading is taken; without a model the fallback encodings
    are tried in order. A text with NULs or control characters, which only an encoding that takes every byte
    accepts, is not a text. Defined inside a function, it is shipped to the executors by value.
    """
    encodings = list(FALLBACK_ENCODINGS)
    marks = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
    control = re.compile(CONTROL)

    def one(raw: bytes) -> tuple[str | None, str | None]:
        marked = next((name for mark, name in marks if raw.startswith(mark)), None)
        if shared is not None and not marked:
            return shared.value.read(raw)
        for name in [marked] if marked else encodings:
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                continue
            if marked or not control.search(text):
                return text, name
        return None, None

    def decode(raw: pd.Series) -> pd.DataFrame:
        pairs = [(None, None) if value is None else one(bytes(value)) for value in raw]
        return pd.DataFrame(pairs, columns=["text", "encoding"], dtype="object")

    return F.pandas_udf(decode, "text string, encoding string")


def decode_text(files: DataFrame, content: str = "content", model: EncodingModel | None = None) -> DataFrame:
    """``files`` with text, encoding and error_code instead of their bytes.

    UTF-8 is decoded in the JVM; only other bytes travel to Python, through Arrow. Empty, blank and
    undecodable files are errors, and so is text with NULs, which is UTF-16 or UTF-32 without a mark, unless a
    ``model`` of ``learn_encodings`` tells UTF-16 and the legacy encodings apart. The byte order mark of UTF-8
    stays in the text.
    """
    other = _foreign_decoder(None if model is None else files.sparkSession.sparkContext.broadcast(model))
    raw = F.col(content)
    utf8 = F.when(~F.contains(raw, F.lit(b"\x00")), F.try_validate_utf8(raw.cast("string")))
    bytes_in = files.withColumn("_utf8", utf8).withColumn(
        "_other", other(F.when(F.col("_utf8").isNull() & raw.isNotNull(), raw))
    )
    text = F.coalesce("_utf8", F.col("_other.text"))
    code = (
        F.when(F.octet_length(raw) == 0, "EMPTY_DOCUMENT")
        .when(raw.isNotNull() & F.col("text").isNull(), "ENCODING_ERROR")
        .when(~not_blank("text"), "NO_CONTENT")
    )
    decoded = (
        bytes_in.withColumn("text", text)
        .withColumn("encoding", F.when(F.col("_utf8").isNotNull(), "utf-8").otherwise(F.col("_other.encoding")))
        .withColumn("error_code", code)
    )
    return decoded.drop("_utf8", "_other", content)


def text_metadata(text: str, raw_size: Column, encoding: Column) -> Column:
    """Metadata of a text file."""
    return F.struct(
        F.lit("TXT").alias("format"),
        encoding.alias("encoding"),
        raw_size.cast("bigint").alias("size_bytes"),
        line_count(text).cast("bigint").alias("line_count"),
    )
