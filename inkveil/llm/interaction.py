"""How filters interact: what each removes in every order that they could be applied in.

A document fails some of the filters, its mask. Orders are ranked lexicographically, as by their Lehmer codes,
so the orders that begin with the same filters are an interval of ranks: after k filters it has (n - k)!
ranks. A mask is removed at the first of its filters in the order; the orders that have that filter at step k
begin with k - 1 filters outside the mask, so they are the union of a few such intervals. Per part, step and
rank the documents of each mask are added where an interval begins and taken off where it ends; prefix sums
over the ranks give all orders at once. No document meets any order: they are counted per part and mask first.

Everything is native; documents are shuffled as digests of their texts, counted before and after.

Defined cases: a null text is empty; a null part is the empty string; a null id has no smaller one and is
none; of repeated rows with the smallest id none fails for the other; a document has a label if any row of
its id has it; parts without documents do not appear; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.shared import stored

FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: short, repetitive, loud, with symbols."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, LETTERS, ""))

    def bits(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return F.when(n < 50, 1).otherwise(0) + F.when(100 * distinct.cast("long") < 65 * n.cast("long"), 2).otherwise(0)

    of_words = F.transform(F.array(words), bits)[0]  # the words are made once
    loud = F.when(100 * capitals.cast("long") > 5 * F.length(text).cast("long"), 4).otherwise(0)
    return of_words + loud + F.when(F.regexp_like(text, F.lit("[#$%&*|]")), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good`` and ``toxic``: documents by the filters that they fail."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text_mask(text).cast("int").alias("mask"),
    )
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    known = marked.join(label, F.col("id") == F.col("of_id"), "left").na.fill(0, ["good", "toxic"])
    group = ["digest", "mask", "part", "good", "toxic"]
    # copies are counted before they meet, so a text with very many of them is a few rows
    rows = known.groupBy(*group, "id").agg(F.count("*").alias("n"))
    copies = rows.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    stays = F.col("unnamed") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    told = copies.withColumn("stays", stays)
    both = F.explode(
        F.array(
            F.struct(F.col("mask"), F.col("stays").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n")),
        )
    )
    each = told.select("part", "good", "toxic", both.alias("m")).where("m.n > 0")
    return each.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"),
        F.sum(F.col("m.n") * F.col("good")).alias("good"),
        F.sum(F.col("m.n") * F.col("toxic")).alias("toxic"),
    )


def intervals(filters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last): where orders remove each mask."""
    n = len(filters)
    out = []
    for step in range(1, n + 1):
        width = factorial(n - step)
        for number, begin in enumerate(permutations(range(n), step)):  # in the order of their ranks
            before = {1 << f for f in begin[:-1]}
            for mask in range(1, 1 << n):
                if mask >> begin[-1] & 1 and not any(mask & bit for bit in before):
                    out.append((mask, step, number * width, (number + 1) * width))
    return out


def orders(filters: str) -> list[tuple[int, str, int, int]]:
    """(rank, order, step, bit of the filter at that step)."""
    ranked = enumerate(permutations(filters))
    return [(rank, "".join(o), step, filters.index(f)) for rank, o in ranked for step, f in enumerate(o, 1)]


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, order of the filters and step, with what that step keeps, removes and loses."""
    spark: SparkSession = docs.sparkSession
    # at most 32 rows a part, read several times below
    counted = stored(mask_counts(docs, labels, id_col, text_col, part_col), "filter-masks")
    total = F.sum("n")
    single = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f) for i, f in enumerate(FILTERS)]
    failing = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)).alias(f"all_{f}") for i, f in enumerate(FILTERS)]
    parts = counted.groupBy("part").agg(total.alias("total"), *single, *failing)

    # both tables are the same for any input
    where = spark.createDataFrame(intervals(FILTERS), "of_mask int, step int, low int, high int")
    ranked = spark.createDataFrame(orders(FILTERS), "rank int, filter_order string, step int, filter int")
    ends = F.explode(
        F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign")))
    )
    changes = counted.join(F.broadcast(where), F.col("mask") == F.col("of_mask")).select("part", "step", "n", "good", "toxic", ends.alias("e"))
    changes = changes.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(
        *(F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in ("n", "good", "toxic"))
    )
    # a row for every part, step and rank, where nothing changes as well
    grid = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    grid = parts.select("part", grid).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(len(FILTERS)) - 1))).alias("rank"))
    zero = F.lit(0).cast("long")
    filled = grid.select("*", *(zero.alias(c) for c in ("n", "good", "toxic"))).unionByName(changes)
    filled = filled.groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = filled.select("part", "step", "rank", *(F.sum(c).over(upto).alias(c) for c in ("n", "good", "toxic")))
    placed = summed.join(F.broadcast(ranked), ["step", "rank"])  # drops the rank beyond the last
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    by_filter = Window.partitionBy("part", "filter")

    def of_filter(prefix: str) -> Column:
        return F.array(*(F.col(f"{prefix}{f}") for f in FILTERS))[F.col("filter")]

    done = placed.withColumn("gone", F.sum("n").over(steps)).withColumn("shapley", F.sum("n").over(by_filter))
    return done.join(parts, "part").select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("gone")).alias("kept"),
        F.col("n").alias("removed"),
        (of_filter("all_") - F.col("n")).alias("redundant"),
        of_filter("").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )
