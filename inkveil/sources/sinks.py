"""Export routes and sinks, and the folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from inkveil.constants import EXPORT_FORMATS


def export_route(output_format: Column) -> Column:
    """The writer of an output format, or the error code ``UNSUPPORTED_FORMAT``."""
    fmt = F.lower(output_format)
    return F.when(fmt.isin(EXPORT_FORMATS), fmt).otherwise("UNSUPPORTED_FORMAT")


def same_as_input(file_type: Column) -> Column:
    """Output format of "same as input": pdf cannot be written and becomes txt."""
    return F.when(F.lower(file_type) == "pdf", "txt").otherwise(F.lower(file_type))


def export_text(outputs: DataFrame, folder: str) -> None:
    """Write (out_path, content) rows as files, each at its path below ``folder``; null contents give none.

    Rows with the same path meet in one task, which refuses them. See ``TextFiles`` for what happens when tasks fail.
    """
    spark = outputs.sparkSession
    spark.dataSource.register(TextFiles)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = outputs.where("content is not null").select("out_path", F.col("content").cast("string").alias("content"))
    rows.repartition(tasks, "out_path").write.format(TextFiles.name()).option("folder", folder).mode("append").save()


class TextFiles(DataSource):
    """A sink of (out_path, content) rows, one file per row.

    A task writes its files to a folder of its own within the job's, notes their names, and then moves each into
    place, so a file is whole or absent, and a repeated task replaces it by the same. A task that fails takes back
    what it moved. When the job fails, its folder is renamed first, so that tasks still running can move nothing
    more, and the noted files of all tasks go. A file that was there before under such a name is not brought back.
    """

    @classmethod
    def name(cls) -> str:
        return "inkveil_text_files"

    def schema(self) -> str:
        return "out_path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        made = TextFileWriter(self.options["folder"])
        made.begin()
        return made


@dataclass
class Written(WriterCommitMessage):
    files: int


class TextFileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.job = f"_export-{uuid.uuid4().hex}"

    def _store(self):
        from inkveil.sources.files import opened

        system, base = opened(self.folder)
        return system, base.rstrip("/"), f"{base.rstrip('/')}/{self.job}"

    def begin(self) -> None:
        system, _, staging = self._store()
        system.create_dir(staging, recursive=True)

    def _below(self, path: str, base: str) -> str:
        """``path`` relative to the folder."""
        for root in (self.folder.rstrip("/"), base):
            if path.startswith(root + "/"):
                parts = path[len(root) + 1 :].split("/")
                if all(part not in ("", ".", "..") for part in parts):
                    return "/".join(parts)
        raise ValueError(f"{path} is not below {self.folder}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base, staging = self._store()
        own = f"{staging}/{uuid.uuid4().hex}"
        names: dict[str, str] = {}
        made, moved = set(), []

        def folder_of(path: str) -> None:
            parent = path.rsplit("/", 1)[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)

        try:
            system.create_dir(own, recursive=False)  # not when the job has failed
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    name = self._below(path, base)
                    if name in names:
                        raise ValueError(f"two texts for {path}")
                    names[name] = f"{own}/{len(names)}"
                    with system.open_output_stream(names[name]) as out:
                        out.write(content.as_buffer() or b"")
            if names:
                with system.open_output_stream(f"{own}.names") as out:
                    out.write("\0".join(names).encode())
            for name, place in names.items():
                folder_of(f"{base}/{name}")
                system.move(place, f"{base}/{name}")
                moved.append(name)
        except BaseException:
            self._delete(system, [f"{base}/{name}" for name in moved])
            raise
        return Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, staging = self._store()
        self._remove(system, staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, base, staging = self._store()
        gone = f"{staging}-failed"
        system.move(staging, gone)
        for info in system.get_file_info(fs.FileSelector(gone)):
            if info.path.endswith(".names"):
                with system.open_input_stream(info.path) as lines:
                    self._delete(system, [f"{base}/{name}" for name in lines.read().decode().split("\0")])
        self._remove(system, gone)

    @staticmethod
    def _delete(system, paths: list[str]) -> None:
        from pyarrow import fs

        for found in system.get_file_info(paths):
            if found.type == fs.FileType.File:
                system.delete_file(found.path)

    @staticmethod
    def _remove(system, staging: str) -> None:
        from pyarrow import fs

        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the warehouse where none is set.

    A local warehouse will do for a session on one machine; on a cluster it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if spark.sparkContext.master.split("[")[0] != "local" and (root.startswith("file:") or ":" not in root):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``shared_root``."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
