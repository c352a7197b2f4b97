"""Benchmark decontamination by greedy string tiling.

Words are compared without case and punctuation. In scripts that are written without spaces each letter is a
word, with the marks on it. Runs of ``least`` words are seeds, and an item of fewer words is one as a whole; an
equality join of the seeds of documents and benchmark items yields the pairs to look at. What the seeds of a pair cover in the
item bounds what tiles can cover, so pairs below the threshold go before any text is compared. The others
are tiled: the longest match of unmarked words is marked again and again, found by running Karp-Rabin
hashing with falling lengths. Tiles may lie in any order, so reordered passages are caught.

Documents are read once. A bit map of fixed size, built from the benchmark's seeds, keeps documents without
any seed out of the join; false positives of the map cost time only. Of a document, only the runs of words
that seeds cover travel on: no other word can be part of a tile.

Defined cases: null texts and those without words match nothing; an item of fewer than ``least`` words is found
where all of them follow each other;
repeated rows of documents or items give one row; equal texts under different ids give a row each; a null id
is reported as null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.shared import small, stored, tidy

#: Words in the shortest tile, which is also the seed.
LEAST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: log2 of the bits in the map of seeds: 8 MB, whatever the benchmark.
MAP_BITS = 26
#: Item words that may be broadcast.
BROADCAST_WORDS = 2_000_000
#: The first length that is searched for.
START_LENGTH = 20
#: Words whose hashes a task remembers.
REMEMBERED = 1_000_000
#: Blocks of the scripts without spaces between words: Han; Thai, Lao, Myanmar, Khmer, Tai, Balinese, Javanese, kana, Yi.
_HAN = "\u3005-\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00017000-\U00018d8f\U0001b000-\U0001b2ff\U00020000-\U0003ffff"
_UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x3040, 0x30FF), (0x31F0, 0x31FF), (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xFF66, 0xFF9F),
]


def _of_category(kind: str) -> str:
    return "".join(chr(c) for low, high in _UNSPACED for c in range(low, high + 1) if unicodedata.category(chr(c))[0] == kind)


_LETTER, _MARK = _HAN + _of_category("L"), _of_category("M")
_ALONE = re.compile(f"[{_LETTER}]")
_SPACED = re.compile(r"\w+")
_WORD = re.compile(rf"[{_LETTER}][{_MARK}]*|[^\W{_LETTER}{_MARK}]+")
_BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """Words to their 64-bit hashes, never zero."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8")) or 1
        return value


def word_hashes(text: str, known: _Hashes) -> np.ndarray:
    if len(known) > REMEMBERED:
        known.clear()
    text = text.lower()
    words = (_SPACED if text.isascii() or not _ALONE.search(text) else _WORD).findall(text)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every run of ``size`` words, by doubling the window."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(count, np.uint64), 0
    power, length = words, 1
    while done < size:
        if size & length:
            out = out * np.uint64(pow(_BASE, length, 1 << 64)) + power[done : done + count]
            done += length
        if done < size:
            power = power[: len(power) - length] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length:]
            length *= 2
    return out


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the greedy tiles of at least ``least`` words."""
    item_free, text_free = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, START_LENGTH)
    while True:
        found = _matches(item, text, item_free, text_free, length)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        found.sort(key=lambda m: (-m[0], m[1], m[2]))
        while found:
            n, p, t = found.pop(0)
            free = item_free[p : p + n] & text_free[t : t + n]
            if free.all():
                out.append((p, t, n))
                item_free[p : p + n] = text_free[t : t + n] = False
                continue
            # what an earlier tile left of this match queues again by its length
            edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
            left = [(int(b - a), p + int(a), t + int(a)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= length]
            if left:
                found = sorted(found + left, key=lambda m: (-m[0], m[1], m[2]))
        if length <= least:
            return out
        length = length // 2 if length > 2 * least else least


def _matches(item, text, item_free, text_free, length) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` unmarked words."""

    def open_windows(free):
        taken = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(taken[length:] == taken[:-length]) if len(free) >= length else np.zeros(0, np.int64)

    item_at, text_at = open_windows(item_free), open_windows(text_free)
    if not len(item_at) or not len(text_at):
        return []
    item_hash, text_hash = window_hashes(item, length)[item_at], window_hashes(text, length)[text_at]
    order = np.argsort(text_hash, kind="stable")
    low = np.searchsorted(text_hash[order], item_hash, "left")
    high = np.searchsorted(text_hash[order], item_hash, "right")
    out = []
    for p, a, b in zip(item_at.tolist(), low.tolist(), high.tolist()):
        for t in text_at[order[a:b]].tolist():
            if not np.array_equal(item[p : p + length], text[t : t + length]):
                continue
            if p and t and item_free[p - 1] and text_free[t - 1] and item[p - 1] == text[t - 1]:
                continue  # part of a match that starts earlier
            n = length
            while (
                p + n < len(item) and t + n < len(text) and item_free[p + n] and text_free[t + n] and item[p + n] == text[t + n]
            ):
                n += 1
            out.append((n, p, t))
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item``, ``key``, ``words`` (hashes) of the items, repeated rows once."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    @F.arrow_udf("array<long>")
    @tidy
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Hashes()
        for texts in batches:
            yield pa.array([_signed(word_hashes(t.as_py(), known)) for t in texts], pa.list_(pa.int64()))

    rows = benchmark.select(F.col(item_col).cast(kind).alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("text is not null").distinct().select("item", F.xxhash64("item", "text").alias("key"), "text")
    return rows.select("item", "key", hashed("text").alias("words"))


def _seeds(items: DataFrame, least: int) -> DataFrame:
    """``seed``, ``key``, ``pos`` of every run of ``least`` words in the items, or of all words if they are fewer."""

    @F.arrow_udf("array<long>")
    @tidy
    def seeds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            words = (np.array(own.as_py(), np.int64).view(np.uint64) for own in lists)
            yield pa.array([_signed(window_hashes(w, min(least, len(w)) or 1)) for w in words], pa.list_(pa.int64()))

    return items.select("key", F.posexplode(seeds("words")).alias("pos", "seed"))


def _seed_map(seeds: DataFrame) -> bytes:
    """The bit map of the seeds: at most 2**(MAP_BITS - 6) words of it reach the driver."""
    slot = F.col("seed").bitwiseAND((1 << MAP_BITS) - 1)
    words = seeds.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(seed & {63} as int))")).alias("bits")
    )
    table = words.toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return bits.tobytes()


def _candidates(docs: DataFrame, seed_map: bytes, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """``id``, ``doc``, ``seeds`` and ``runs`` of the documents in which a seed of one of the ``sizes`` may occur: the
    words that the seeds cover, with a zero after each run."""
    shared = docs.sparkSession.sparkContext.broadcast(seed_map)

    @F.arrow_udf("struct<seeds: array<long>, runs: array<long>>")
    @tidy
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, bits = _Hashes(), np.frombuffer(shared.value, np.uint8)
        kind = pa.list_(pa.int64())
        for texts in batches:
            seeds, runs = [], []
            for text in texts:
                words = word_hashes(text.as_py() or "", known)
                edge, own = np.zeros(len(words) + 1, np.int64), []
                for size in sizes:
                    grams = window_hashes(words, size)
                    slot = grams & np.uint64((1 << MAP_BITS) - 1)
                    hit = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    own.append(grams[hit])
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + size, -1)
                if not any(map(len, own)):
                    seeds.append(None)
                    runs.append(None)
                    continue
                inside = np.cumsum(edge) > 0
                ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
                kept = np.insert(np.where(inside[:-1], words, 0), ends, 0)
                keep = np.insert(inside[:-1], ends, True)
                seeds.append(_signed(np.unique(np.concatenate(own))))
                runs.append(_signed(kept[keep]))
            yield pa.StructArray.from_arrays([pa.array(seeds, kind), pa.array(runs, kind)], ["seeds", "runs"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("text is not null").select("id", F.xxhash64("id", "text").alias("doc"), search("text").alias("s"))
    return rows.where("s.seeds is not null").select("id", "doc", "s.seeds", "s.runs")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item of whose words at least the share ``coverage`` is tiled:
    ``id_col``, ``item_col``, ``tiles``, ``covered``, ``item_words``, ``coverage``."""
    items = stored(_items(benchmark, item_col, item_text_col), "tiling-items")
    seeds = stored(_seeds(items, least), "tiling-seeds")
    shortest = F.least(F.size("words"), F.lit(least))
    sizes = sorted(r[0] for r in items.where(F.size("words") > 0).select(shortest).distinct().collect())  # at most ``least``
    found = stored(_candidates(docs, _seed_map(seeds), sizes, id_col, text_col), "tiling-documents")
    found = found.dropDuplicates(["doc"])
    lengths = items.select(F.col("key").alias("length_key"), F.size("words").alias("item_words"))
    width = F.least(F.col("item_words"), F.lit(least))
    reach = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + width - 1)))))
    pairs = (
        found.select("doc", F.explode("seeds").alias("seed"))
        .join(small(seeds.withColumnRenamed("seed", "item_seed")), F.col("seed") == F.col("item_seed"))
        .groupBy("doc", "key")
        .agg(F.collect_set("pos").alias("at"))  # at most as many as the item has words
        .join(small(lengths), F.col("key") == F.col("length_key"))
        .where(reach >= coverage * F.col("item_words"))
        .select(F.col("doc").alias("pair_doc"), F.col("key").alias("pair_key"))
    )
    pairs = stored(pairs, "tiling-pairs")

    @F.arrow_udf("struct<tiles: int, covered: int>")
    @tidy
    def tiled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for words, runs in batches:
            counts = []
            for item, text in zip(words, runs):
                item, text = np.array(item.as_py(), np.int64), np.array(text.as_py(), np.int64)
                made = tiles(item, text, min(least, len(item)))
                counts.append({"tiles": len(made), "covered": sum(n for _, _, n in made)})
            yield pa.array(counts, pa.struct([("tiles", pa.int32()), ("covered", pa.int32())]))

    total = lengths.agg(F.sum("item_words")).first()[0] or 0
    known = F.broadcast(items) if total <= BROADCAST_WORDS else items
    result = (
        found.join(pairs, F.col("doc") == F.col("pair_doc"))
        .join(known, F.col("pair_key") == F.col("key"))
        .select("id", "item", F.size("words").alias("item_words"), tiled("words", "runs").alias("t"))
    )
    share = F.col("t.covered") / F.col("item_words")
    return result.where(share >= coverage).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "t.tiles", "t.covered", "item_words", share.alias("coverage")
    )
