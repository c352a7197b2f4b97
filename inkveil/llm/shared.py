"""What the operators of this package share: stored tables, size-checked broadcasts, dropping rows."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.sources.sinks import shared_root

#: Rows of up to 32 bytes that may be broadcast (about 64 MB as a hashed relation).
BROADCAST_ROWS = 1_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``stored``, in buckets by ``key``: a join or grouping on it need not shuffle these rows again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def small(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """``df`` marked for broadcast if it was counted and is within bounds; else marked for a sorted join.

    ``row_bytes`` is what a row takes at most; rows without such a bound are not to be given here. Left to itself,
    Spark would go by its estimate, which is too low for compressed files and exploded rows on either side.
    """
    return df.hint("broadcast" if df.count() * row_bytes <= BROADCAST_ROWS * 32 else "merge")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose never-null ``key`` is in the stored one-column table ``gone``.

    The keys are broadcast if counted as few, else the join shuffles. ``docs`` may have columns of any name.
    """
    own = free_name(docs, "_gone")
    return docs.join(small(gone.toDF(own)), key == F.col(own), "left_anti")


def tidy(work: Callable) -> Callable:
    """The iterator function ``work``, which gives free memory back to the system when it ends.

    Python workers live on between tasks, and several of them may wait beside the ones at work.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def pieces(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches, or tuples of Arrow columns, a few rows at a time: what is made of them stays small."""
    for batch in batches:
        size = len(batch[0]) if isinstance(batch, tuple) else len(batch)
        for at in range(0, size, rows):
            yield tuple(c.slice(at, rows) for c in batch) if isinstance(batch, tuple) else batch.slice(at, rows)
