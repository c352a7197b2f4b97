"""The corpus pipeline: documents through five stages, each one operator of ``inkveil.llm``.

A stage gets what the one before kept, and returns the columns of ``documents``, the last one its digests.
Rows are told apart by ``doc_id`` and text: where a whole row is repeated, exact dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import decontaminate, exact, language, simhash
from inkveil.llm.queries import held_out, table, token_digests
from inkveil.llm.shared import free_name, small, stored, without


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without a letter."""
    model = language.learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    told = language.predict(docs.select(row_hash().alias("row"), "text"), model)
    gone = told.where(F.col("lang_pred") == language.UNKNOWN).select("row").distinct()
    return without(docs, stored(gone, "unknown-language"), row_hash())


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    told = stored(exact.exact_duplicates(docs), "exact-told")
    kept = told.groupBy("row_hash").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    left = without(docs, stored(kept.where("not kept").select("row_hash"), "exact-gone"), row_hash())
    repeated = stored(kept.where("kept and rows > 1").select("row_hash"), "exact-repeated")
    if repeated.isEmpty():
        return left
    own = free_name(left, "row_hash")
    more = left.join(small(repeated.toDF(own)), row_hash() == F.col(own), "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, repeated, row_hash()).unionByName(more)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id; rows without an id come last."""
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_hash().alias("hash")).alias("row"), "text")
    groups = simhash.near_duplicates(rows, shingle=3, k=2, seed=42, id_col="row")
    gone = groups.where("row != component_id").select("row.hash").distinct()
    return without(docs, stored(gone, "near-gone"), row_hash())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    rows = docs.select(row_hash().alias("row"), "text")
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="row")
    return without(docs, stored(found.select("row").distinct(), "contaminated"), row_hash())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, encoded and decoded again, as digests."""
    return token_digests(docs, block_bytes=8 << 20)  # executors still hold memory of the stages before


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Partial matching, SimHash components, tiling and byte-pair merging have no SQL form; tests/llm compares
#: the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
