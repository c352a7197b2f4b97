"""Stored tables laid out by task: in folders by hash bucket, or bucketed for joins.

``bucket`` is the name of the folders' column; a table must not have one of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a table; a refresh rewrites those of its tasks only.
BUCKETS = 256
BUCKET = "bucket"
#: What a row of a refresh is.
STORED, NEW, NAMED = 0, 1, 2


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_by_task(df: DataFrame, path: str, key: str = "task_id", buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Write ``df`` in folders by bucket of ``key``."""
    rows = df.withColumn(BUCKET, bucket_of(key, buckets))
    writer = rows.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" else "static")
    writer.partitionBy(BUCKET).parquet(path)


def read_by_task(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of a table that ``write_by_task`` has written."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, {BUCKET} int")
    return reader.parquet(path).drop(BUCKET)


def refreshed(stored: DataFrame, fresh: DataFrame, names: DataFrame | None, key: str) -> DataFrame:
    """``fresh``, and the ``stored`` rows of tasks that are not in ``names`` (those of ``fresh`` where none are given).

    All have a column ``bucket`` and are shuffled once, by it; a window over each task tells which rows go.
    """
    kinds = [stored.withColumn("_kind", F.lit(STORED)), fresh.withColumn("_kind", F.lit(NEW))]
    if names is not None:
        kinds.append(names.withColumn("_kind", F.lit(NAMED)))
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds).repartition(BUCKET)
    task = Window.partitionBy(BUCKET, key)  # in place, as the rows of a bucket are together; nulls are one task
    gone = F.max(F.col("_kind") == (NEW if names is None else NAMED)).over(task)
    after = met.withColumn("_gone", gone).where((F.col("_kind") == NEW) | ((F.col("_kind") == STORED) & ~F.col("_gone")))
    return after.drop("_kind", "_gone")


def refresh_by_task(
    spark: SparkSession, path: str, new: DataFrame, tasks: DataFrame | None = None, key: str = "task_id", buckets: int = BUCKETS
) -> None:
    """Replace all rows of the ``tasks`` (those of ``new`` where none are given) by ``new`` in the stored table.

    Only the buckets of these tasks and of ``new`` are read and written; the files of the others stay as they are. A
    bucket that is left without rows is removed. After a failure the same refresh gives the same table.
    """
    from inkveil.sources.sinks import shared_folder

    target = shared_folder(spark, "refresh")  # ``new`` may be made of the table that it goes to
    new.withColumn(BUCKET, bucket_of(key, buckets)).write.parquet(target)
    fresh = spark.read.parquet(target)
    names = (fresh if tasks is None else tasks).select(key).withColumn(BUCKET, bucket_of(key, buckets))
    # at most ``buckets`` numbers
    touched = [r[0] for r in names.select(BUCKET).union(fresh.select(BUCKET)).distinct().collect()]
    if not touched:
        return
    stored = spark.read.schema(fresh.schema).parquet(path).where(F.col(BUCKET).isin(touched))
    after = refreshed(stored, fresh, None if tasks is None else names, key)
    # the buckets that get rows, as bits of whole numbers
    words = [
        F.bit_or(F.when(F.floor(F.col(BUCKET) / 32) == w, F.expr(f"shiftleft(1L, {BUCKET} % 32)")).otherwise(0)).alias(str(w))
        for w in range(-(-buckets // 32))
    ]
    written = Observation()
    rows = after.observe(written, *words)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    left = written.get
    for number in touched:
        if not (left[str(number // 32)] or 0) >> number % 32 & 1:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={number}")
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a catalog table in buckets by ``key``, one sorted file each.

    Tables with the same number of buckets are joined on their keys without a shuffle.
    """
    spark = df.sparkSession
    rows = df.repartition(buckets, key)
    rows.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
