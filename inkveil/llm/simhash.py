"""SimHash near-duplicates by deletion variants.

A fingerprint has 64 bits; two fingerprints are linked when they differ in at most ``k`` bits. The bits
are cut into ``k // 2 + 1`` segments, so in any linked pair some segment differs in at most one bit. Every
segment is indexed as it is and with each of its bits as a wildcard; an equality join on these variants
finds all candidates, and the full distance decides. For even ``k`` the last segment needs no wildcards:
where it alone differs in at most one bit, it does not differ at all.

Work is on distinct fingerprints, so copies cost nothing. A variant shared by many fingerprints is joined
on a second variant, taken from the bits outside the segment with the distance that is left.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a null id
takes part in a group but never names it unless all its ids are null; repeated rows are returned as often
as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.components import components
from inkveil.llm.shared import small, stored, tidy

BITS = 64
#: A variant with more distinct fingerprints than this is joined on a second variant as well.
HOT_MEMBERS = 256
#: Hashes expanded into bits at a time.
EXPAND = 1 << 16


def fingerprint_of(text: str | None, shingle: int, seed: int) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    import xxhash

    if not text:
        return 0
    words = text.encode("utf-8").lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        digests = [digest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        digests = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), EXPAND):
        block = np.frombuffer(b"".join(digests[at : at + EXPAND]), np.uint8)
        ones += np.unpackbits(block).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """Bit by bit the majority of the XXH64 hashes of a text's word shingles, as a long."""

    @F.pandas_udf("long")
    @tidy
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, shingle, seed) for t in texts], dtype="int64")

    return of(text)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _segments(bits: list[int], k: int) -> list[list[int]]:
    count = k // 2 + 1
    cuts = [len(bits) * i // count for i in range(count + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _variants(fp: Column, bits: list[int], k: int) -> Column:
    """All variants of the given bits: ``wild`` is -1 or the wildcard's bit, ``one`` the value it hides."""
    out = []
    for n, own in enumerate(segments := _segments(bits, k)):
        value = fp.bitwiseAND(F.lit(_signed(_mask(own))))
        wilds = [] if k % 2 == 0 and n == len(segments) - 1 else own
        for wild in [-1, *wilds]:
            if wild < 0:
                key, one = value, F.lit(False)
            else:
                key = value.bitwiseAND(F.lit(_signed(~(1 << wild) & ((1 << BITS) - 1))))
                one = fp.bitwiseAND(F.lit(_signed(1 << wild))) != 0
            out.append(F.struct(F.lit(n).alias("seg"), F.lit(wild).alias("wild"), key.alias("key"), one.alias("one")))
    return F.array(*out)


def _pairs(rows: DataFrame, levels: list[str], k: int) -> DataFrame:
    """Pairs of fingerprints that agree in the variants of all ``levels`` and are within ``k`` bits."""
    # sorted, never broadcast: Spark sizes exploded rows as if each fingerprint had one variant
    a, b = rows.hint("merge").alias("a"), rows.alias("b")
    on = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= k)
    for v in levels:
        for part in ("seg", "wild", "key"):
            on &= F.col(f"a.{v}.{part}") == F.col(f"b.{v}.{part}")
        # a wildcard stands for bits that differ; equal ones meet in the variant without wildcard
        on &= (F.col(f"a.{v}.wild") < 0) | (F.col(f"a.{v}.one") != F.col(f"b.{v}.one"))
    return a.join(b, on).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def links(fps: DataFrame, k: int, hot_members: int = HOT_MEMBERS) -> DataFrame:
    """All pairs (src < dst) of the distinct fingerprints in column ``fp`` that differ in at most ``k`` bits."""
    every = list(range(BITS))
    rows = fps.select("fp", F.explode(_variants(F.col("fp"), every, k)).alias("v"))
    keys = ["seg", "wild", "key"]
    hot = (
        rows.groupBy(*(F.col(f"v.{c}").alias(f"hot_{c}") for c in keys))
        .count()
        .where(F.col("count") > hot_members)
        .drop("count")
    )
    hot = stored(hot, "simhash-hot")
    if hot.isEmpty():
        return _pairs(rows, ["v"], k).distinct()
    hot = small(hot)
    same = [F.col(f"v.{c}") == F.col(f"hot_{c}") for c in keys]
    cold = rows.join(hot, same, "left_anti")
    second = None
    for n, own in enumerate(_segments(every, k)):
        rest = [b for b in every if b not in set(own)]
        for wild, left in ((F.col("v.wild") < 0, k), (F.col("v.wild") >= 0, k - 1)):
            if left < 0:
                continue
            case = (F.col("v.seg") == n) & wild
            made = _variants(F.col("fp"), rest, left)
            second = F.when(case, made) if second is None else second.when(case, made)
    refined = rows.join(hot, same, "left_semi").select("fp", "v", F.explode(second).alias("w"))
    return _pairs(cold, ["v"], k).union(_pairs(refined, ["v", "w"], k)).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    k: int = 2,
    seed: int = 42,
    hot_members: int = HOT_MEMBERS,
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    that can be reached over links of at most ``k`` differing bits."""
    marked = stored(
        docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle, seed).alias("fp")), "simhash-fp"
    )
    fps = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    groups = components(stored(links(fps.select("fp"), k, hot_members), "simhash-links"))
    # what has a row per fingerprint or document is sorted, however small Spark takes its files to be
    named = fps.join(groups.hint("merge"), fps["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.hint("merge").join(names, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return marked.hint("merge").join(classes, marked["fp"] == classes["class_fp"]).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
