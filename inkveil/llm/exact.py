"""Exact duplicates by a stateful stream.

Documents arrive as a stream of digests. The stream's keyed state, kept on disk by RocksDB and without
expiry, holds for each digest the smallest document id so far, a locator of that document's content and
the number of documents. Every micro-batch appends the digests it changed to a log; the last entry of a
digest is its state. A hit, i.e. a document whose digest was taken, is checked on the full bytes of the
kept document, and documents that merely share the digest are grouped by their bytes instead.

Only DataFrame operations are used. The hits of a hot digest are dealt over many tasks, to which the kept
text is copied.

Defined cases: a null text counts as empty; a null id comes after all ids; of repeated rows (equal id and
text) exactly one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.shared import shared_path, small, stored

BLANKS = r"[\x20\x09-\x0D]+"
#: Hits of a digest that are checked against one copy of the kept text.
HITS_PER_COPY = 512
#: Files of arrivals that make a micro-batch.
FILES_PER_BATCH = 256
#: The store on disk, without space set aside in advance for each partition's files, and with one bound on the
#: native memory of all partitions of an executor.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def normalised(text: Column) -> Column:
    """The text with every run of ASCII blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keep_state(arrivals: DataFrame, log_path: str, checkpoint_path: str) -> None:
    """Runs the streaming DataFrame ``arrivals`` (digest, id, locator) up to its present end.

    The state of each changed digest is appended to the Parquet log at ``log_path``. A batch that is
    repeated after a failure overwrites its own folder. Started again with the same paths, the stream
    goes on from its state.
    """
    spark = arrivals.sparkSession
    state = arrivals.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")).alias("first"), F.count("*").alias("n")
    )

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        run = (
            state.writeStream.outputMode("update")
            .foreachBatch(append)
            .option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and
    ``row_hash`` (XXH64 of id and text as given).

    Texts are equal when their normalised bytes are; of equal texts the row with the smallest id is kept.
    ``digest`` is the state's key; a weak one costs time, not correctness.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("given")).withColumn(
        "row_hash", F.xxhash64("id", "given")
    )
    text = normalised(F.col("given"))
    locator = F.struct(F.col("row_hash").alias("content"), F.monotonically_increasing_id().alias("row"))
    feed = stored(
        given.select(
            "id", "row_hash", digest(text).alias("digest"), sha256(text).alias("text_sha256"), locator.alias("locator")
        ),
        "exact-arrivals",
    )
    log_path = shared_path(spark, "exact-log")
    log_schema = _grouped(feed, "digest").schema
    # made in the JVM: rows from Python would start workers that then stay
    spark.sql("select 1 as n").where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in log_schema)).write.parquet(f"{log_path}/batch=-1")
    folder = feed.inputFiles()[0].rsplit("/", 1)[0]
    arrivals = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    keep_state(arrivals, log_path, shared_path(spark, "exact-state"))
    log = spark.read.schema(log_schema.add("batch", "integer")).parquet(log_path)
    latest = log.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s"))
    state = stored(latest.select("digest", "s.first", "s.n"), "exact-groups")

    collided = _collisions(given, feed, state, digest)
    keys = ["digest"]
    if not collided.isEmpty():
        # equal digests of different texts: the SHA-256 of the bytes tells them apart
        keys = ["digest", "text_sha256"]
        state = stored(_grouped(feed, *keys), "exact-regrouped")
    groups = state.select(*(F.col(c).alias(f"of_{c}") for c in keys), "first", "n")
    same = [F.col(c) == F.col(f"of_{c}") for c in keys]
    return feed.hint("merge").join(groups, same).select(  # a row per document: not to be broadcast by the size of its files
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("locator.row") == F.col("first.locator.row")).alias("kept"),
        "text_sha256",
        "row_hash",
    )


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "locator"))
    return rows.groupBy(*keys).agg(first.alias("first"), F.count("*").alias("n"))


def _collisions(given: DataFrame, feed: DataFrame, state: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests of hits whose full bytes differ from the kept document's, which its locator finds."""
    shared = state.where("n > 1").select(F.col("digest").alias("hit_digest"), "first", "n")
    listed = stored(
        feed.hint("merge").join(shared, F.col("digest") == F.col("hit_digest"))
        .select(
            F.col("row_hash").alias("hit_row"),
            "hit_digest",
            F.ceil(F.col("n") / HITS_PER_COPY).cast("int").alias("copies"),
            (F.col("row_hash") == F.col("first.locator.content")).alias("is_first"),
        )
        .distinct(),
        "exact-hits",
    )
    text = normalised(F.col("given"))
    hits = (
        given.join(small(listed, row_bytes=192), F.col("row_hash") == F.col("hit_row"))
        .where(digest(text) == F.col("hit_digest"))
        .select("hit_digest", "copies", "is_first", "row_hash", text.alias("text"))
    )
    kept = (
        hits.where("is_first")
        .groupBy("hit_digest")
        .agg(F.min("text").alias("kept_text"), F.max("copies").alias("copies"))
        .select(F.col("hit_digest").alias("digest"), "kept_text", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    )
    dealt = hits.withColumn("to", F.pmod("row_hash", "copies").cast("int"))
    wrong = dealt.join(kept, (F.col("hit_digest") == F.col("digest")) & (F.col("to") == F.col("copy"))).where(
        F.col("text") != F.col("kept_text")
    )
    return stored(wrong.select("hit_digest").distinct(), "exact-collisions")
