"""Removal of byte strings that occur more than once, by suffix arrays.

A string of ``length`` bytes that also starts elsewhere is to be found in the whole corpus. A suffix array of
everything would have to be merged across all shards, each against each; so anchors bring together what can
be equal. In every string of that length, the smallest hash among its runs of ``gram`` bytes is its anchor:
equal strings have equal anchors at equal places. Strings that follow each other mostly share one, and the
bytes under them are the anchor's context.

1. Anchors whose hash occurs once in the corpus are gone after one count.
2. Contexts of the others are counted by a 128-bit digest; equal contexts are repeated as a whole.
3. Contexts that occur once, under an anchor that has others, are compared by bytes. They are dealt by anchor
   and each task cuts them into shards; per shard a suffix array is refined by Larsson-Sadakane doubling and
   Kasai's common prefixes mark the strings that are repeated. An anchor that spans several shards of a task
   is merged by binary search in the other shards' arrays. Strings of an anchor with very many contexts are
   counted by their digests instead, so that no task gathers them.
4. The marked starts go back to their documents, and the bytes they cover are removed.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` are never touched; repeated
rows are documents of their own, so their strings are repeated; a null id is passed through; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.shared import BROADCAST_ROWS, pieces, small, stored, tidy

LENGTH = 400
#: Bytes in the runs that anchors are chosen from.
GRAM = 64
#: Bytes in which anchors are looked for at a time; a longer text goes in overlapping segments.
SEGMENT = 4 << 20
#: Bytes of contexts in a suffix array.
SHARD_BYTES = 1 << 20
#: Distinct contexts of an anchor that are compared in one task.
HOT_CONTEXTS = 10_000
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A well mixed hash of every run of ``size`` bytes."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(count, np.uint64), 0
    power, length = data.astype(np.uint64), 1
    while done < size:
        if size & length:
            out = out * np.uint64(pow(_BASE, length, 1 << 64)) + power[done : done + count]
            done += length
        if done < size:
            power = power[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length:]
            length *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last start of the strings that it anchors."""
    hashes = gram_hashes(data, gram)
    width, n = length - gram + 1, len(hashes)
    low = np.uint64(0xFFFFFF)
    keys = (hashes & ~low) | np.arange(n, dtype=np.uint64)  # of equal hashes the first place
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    return hashes[place[first]].view(np.int64), place[first], first, last


def segments(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Offsets and bytes of overlapping segments; every string lies in exactly one that starts in it."""
    view = np.frombuffer(data, np.uint8)
    for at in range(0, max(len(view) - length + 1, 0), SEGMENT):
        yield at, view[at : at + SEGMENT + length - 1]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The places of all suffixes of ``data`` in their order.

    Larsson-Sadakane refinement: groups ordered by 2k bytes come from sorting each group of k bytes by the
    group of the suffix k bytes on. Groups of one are not touched again.
    """
    n, known = len(data), 8
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    new = np.concatenate(([True], np.diff(key[order]) != 0)) if n else np.zeros(0, bool)
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0  # a group's number is its first place
    while True:
        size = np.diff(np.concatenate((np.flatnonzero(new), [n])))
        places = np.flatnonzero(np.repeat(size > 1, size))
        if not len(places):
            return order
        own = order[places]
        onward = own + known
        behind = np.where(onward < n, rank[np.minimum(onward, n - 1)] + 1, 0)
        by = np.argsort((rank[own].astype(np.int64) << 32) | behind, kind="stable")
        group, behind = rank[own][by], behind[by]
        order[places] = own[by]
        starts = np.concatenate(([True], (np.diff(group) != 0) | (np.diff(behind) != 0)))
        rank[order[places]] = places[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        new[places] = starts
        known *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, lanes: int = 2048) -> np.ndarray:
    """Kasai's common prefix of each suffix in ``order`` with the one before it, up to ``limit`` bytes.

    The text is cut into lanes that advance together, each keeping its own running length.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((data, np.zeros(limit + 8, np.uint8)))
    eight = np.zeros(n + limit + 1, np.uint64)  # the eight bytes from each place on, the first one lowest
    for i in range(8):
        eight |= padded[i : i + len(eight)].astype(np.uint64) << np.uint64(8 * i)
    out = np.zeros(n, np.int32)
    step = -(-n // lanes) if n else 0
    at = np.arange(0, n, step) if n else np.zeros(0, np.int64)
    ends = np.minimum(at + step, n)
    have = np.zeros(len(at), np.int64)
    for _ in range(step):
        live = np.flatnonzero((at < ends) & (before[np.minimum(at, n - 1)] >= 0))
        have[before[np.minimum(at, n - 1)] < 0] = 0
        while len(live):
            a, b = at[live] + have[live], before[at[live]] + have[live]
            differ = eight[a] ^ eight[b]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            same = np.minimum(same, n - np.maximum(a, b))
            have[live] += same
            live = live[(same == 8) & (have[live] < limit)]
        have = np.minimum(have, limit)
        now = at < ends
        out[at[now]] = have[now]
        have = np.maximum(have - 1, 0)
        at = at + 1
    return out[order]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like them, zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(data)]
    return out


def find(data: np.ndarray, order: np.ndarray, texts: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: the range of ``order`` whose suffixes of ``data`` begin with each string of ``length``
    bytes of ``texts``."""
    n, theirs, ours = len(data), eights(data), eights(texts)

    def less(places: np.ndarray, at: np.ndarray, or_equal: bool) -> np.ndarray:
        out = np.full(len(places), or_equal)
        open_ = np.arange(len(places))
        for i in range(0, length, 8):
            if not len(open_):
                break
            p, size = places[open_].astype(np.int64) + i, min(8, length - i)
            cut = np.uint64(8 * (8 - size))
            a = np.where(p < n, theirs[np.minimum(p, n - 1)], np.uint64(0)) >> cut
            b = ours[at[open_] + i] >> cut
            # one that ends here is less than what goes on
            out[open_[(a < b) | (a == b) & (p + size > n)]] = True
            out[open_[a > b]] = False
            open_ = open_[(a == b) & (p + size <= n)]
        return out

    def search(low: np.ndarray, at: np.ndarray, or_equal: bool) -> np.ndarray:
        low, high = low.copy(), np.full(len(at), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            right = less(order[mid], at[open_], or_equal)
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    low = search(np.zeros(len(starts), np.int64), starts, False)
    high = low.copy()
    # most strings are not there: the end of the range is looked for where it is not empty
    there = np.flatnonzero(low < len(order))
    there = there[less(order[low[there]], starts[there], True)]
    high[there] = search(low[there], starts[there], True)
    return low, high


class Shard:
    """Contexts under one suffix array. ``contexts`` are (anchor, weight, windows, bytes)."""

    def __init__(self, contexts: list[tuple[int, int, int, bytes]], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(c[3] for c in contexts), np.uint8)
        sizes = np.array([len(c[3]) for c in contexts], np.int64)
        self.windows = np.array([c[2] for c in contexts], np.int64)
        self.anchors = np.array([c[0] for c in contexts], np.int64)
        self.offsets = np.cumsum(sizes) - sizes
        self.weight = np.zeros(len(self.data), np.int32)  # occurrences of the string at each start
        for offset, windows, context in zip(self.offsets.tolist(), self.windows.tolist(), contexts):
            self.weight[offset : offset + windows] = min(context[1], 1 << 30)
        self.order = suffix_array(self.data)
        same = common_prefixes(self.data, self.order, length) >= length
        run = (np.cumsum(~same) - 1).astype(np.int32)
        self.total = np.zeros(len(self.data), np.int64)  # beyond 32 bits only with as many copies
        if len(run):
            self.total[self.order] = np.bincount(run, self.weight[self.order]).astype(np.int64)[run]

    def starts_of(self, anchor: int) -> np.ndarray:
        own = np.flatnonzero(self.anchors == anchor)
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(self.offsets[i], self.offsets[i] + self.windows[i]) for i in own)])

    def merge(self, other: Shard, anchor: int) -> None:
        """Adds the occurrences in ``other`` to this shard's strings under the anchor."""
        starts = self.starts_of(anchor)
        low, high = find(other.data, other.order, self.data, starts, self.length)
        held = np.concatenate(([0], np.cumsum(other.weight[other.order], dtype=np.int64)))
        self.total[starts] += held[high] - held[low]

    def marked(self, n: int) -> list[tuple[int, int]]:
        """First and last of each run of repeated starts in the ``n``-th context."""
        offset = self.offsets[n]
        hit = self.total[offset : offset + self.windows[n]] > 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _anchored(text: str | None, length: int, gram: int):
    """Per segment of a text: its bytes, the segment's offset, and the anchors."""
    data = (text or "").encode("utf-8")
    for at, part in segments(data, length):
        yield data, at, anchors(part, length, gram)


def _anchor_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``h``: anchors that occur more than once; counted per batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for text in batch.column(1):
                found += [own[0] for _, _, own in _anchored(text.as_py(), length, gram)]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "n": pa.array(n, pa.int64())})

    counted = docs.mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return stored(counted.where("n > 1").select("h"), "repeats-anchors")


def _occurrences(docs: DataFrame, repeated: DataFrame, length: int, gram: int) -> DataFrame:
    """``row``, ``h``, ``c1``, ``c2`` (digest of the context), ``start``, ``windows`` of repeated anchors."""
    kinds = [("row", pa.string()), ("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())]
    schema = pa.schema(kinds)
    few = repeated.count() <= BROADCAST_ROWS
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(repeated.toArrow().column(0).to_numpy()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, digest = wanted.value, xxhash.xxh3_128_digest
        for batch in pieces(batches):
            rows: list[str] = []
            columns: list[list[np.ndarray]] = [[] for _ in kinds[1:]]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for data, at, (hashes, place, first, last) in _anchored(text.as_py(), length, gram):
                    if known is not None:
                        found = np.searchsorted(known, hashes)
                        keep = np.flatnonzero(np.append(known, 0)[found] == hashes) if len(known) else np.zeros(0, np.int64)
                        keep = keep[found[keep] < len(known)]
                        hashes, place, first, last = hashes[keep], place[keep], first[keep], last[keep]
                    starts, ends = (at + first).tolist(), (at + last + length).tolist()
                    made = b"".join([digest(data[a:b], p) for a, b, p in zip(starts, ends, (place - first).tolist())])
                    both = np.frombuffer(made, "<i8").reshape(-1, 2)
                    rows += [row] * len(hashes)
                    for column, values in zip(columns, (hashes, both[:, 0], both[:, 1], at + first, last - first + 1)):
                        column.append(values)
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *c]), k) for c, (_, k) in zip(columns, kinds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), *arrays], schema=schema)

    found = docs.select("row", "text").mapInArrow(tidy(run), "row string, h long, c1 long, c2 long, start long, windows int")
    if not few:
        found = found.join(repeated.withColumnRenamed("h", "of_h"), F.col("h") == F.col("of_h"), "left_semi")
    return stored(found, "repeats-occurrences")


def _among(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose ``row`` may be in the stored ``listed`` (``of_row``), or surely is not.

    Eight bytes a row are broadcast if they were counted as few. A hash that two rows share keeps both, which
    an exact join sorts out.
    """
    keys = listed.select(F.xxhash64("of_row").alias("key")).distinct()
    return docs.join(small(keys), F.xxhash64("row") == F.col("key"), how)


def _with_bytes(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """``contexts`` (row, h, n, start, windows) with their ``bytes``."""
    lists = contexts.groupBy(F.col("row").alias("of_row")).agg(F.collect_list(F.struct("h", "n", "start", "windows")).alias("list"))
    lists = stored(lists, "repeats-lists")
    texts = _among(docs, lists, "left_semi").join(lists, F.col("row") == F.col("of_row")).select("row", "text", "list")
    kinds = [("row", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("bytes", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            columns: list[list] = [[] for _ in kinds]
            for row, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8")
                for c in own:
                    start, windows = c["start"], c["windows"]
                    for column, value in zip(columns, (row, c["h"], c["n"], start, windows, data[start : start + windows + length - 1])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], schema=schema)

    return texts.mapInArrow(tidy(run), "row string, h long, n long, start long, windows int, bytes binary")


def _compared(length: int):
    """Marks of the single contexts (n = 1) among rows that come anchor by anchor."""
    kinds = [("row", pa.string()), ("first", pa.int64()), ("last", pa.int64())]
    schema = pa.schema(kinds)

    def marks(shards: list[tuple[Shard, list[dict]]]) -> pa.RecordBatch:
        rows = []
        for shard, contexts in shards:
            for i, c in enumerate(contexts):
                if c["n"] == 1:
                    rows += [{"row": c["row"], "first": c["start"] + a, "last": c["start"] + b} for a, b in shard.marked(i)]
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[Shard, list[dict]]] = []  # shards whose last anchor goes on
        contexts: list[dict] = []
        size = 0

        def cut(following: int | None) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            shard = Shard([(c["h"], c["n"], c["windows"], c["bytes"]) for c in contexts], length)
            first, last = contexts[0]["h"], contexts[-1]["h"]
            for other, theirs in waiting:
                if theirs[-1]["h"] == first:
                    other.merge(shard, first)
                    shard.merge(other, first)
            if waiting and not (first == last == following):
                yield marks(waiting)
                waiting = []
            if last == following:
                waiting.append((shard, contexts))
            else:
                yield marks([(shard, contexts)])

        for batch in pieces(batches):
            for row in batch.to_pylist():
                if contexts and size + len(row["bytes"]) > SHARD_BYTES:
                    yield from cut(row["h"])
                    contexts, size = [], 0
                contexts.append(row)
                size += len(row["bytes"])
        if contexts:
            yield from cut(None)

    return tidy(run)


def _window_digests(length: int):
    """Digest and place of every string of the contexts."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("row", pa.string()), ("first", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches, 64):
            rows = []
            for c in batch.to_pylist():
                for i in range(c["windows"]):
                    w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(c["bytes"][i : i + length]), "<i8").tolist()
                    rows.append({"w1": w1, "w2": w2, "row": c["row"], "first": c["start"] + i, "n": c["n"]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return tidy(run)


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """``row``, ``first``, ``last``: runs of starts in ``docs`` (row, text) of strings that start elsewhere too."""
    occurrences = _occurrences(docs, _anchor_counts(docs, length, gram), length, gram)
    contexts = stored(
        occurrences.groupBy("h", "c1", "c2").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "start", "windows")).alias("at")
        ),
        "repeats-contexts",
    )
    alike = contexts.where("n > 1").select(F.col("h").alias("of_h"), F.col("c1").alias("of_c1"), F.col("c2").alias("of_c2"))
    same = (F.col("h") == F.col("of_h")) & (F.col("c1") == F.col("of_c1")) & (F.col("c2") == F.col("of_c2"))
    whole = occurrences.join(alike, same, "left_semi").select(
        "row", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last")
    )
    mixed = (
        contexts.groupBy(F.col("h").alias("of_h"))
        .agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
        .where("kinds > 1 and least = 1")
    )
    wanted = contexts.join(mixed, F.col("h") == F.col("of_h")).select("at.row", "h", "n", "at.start", "at.windows", "kinds")
    wanted = stored(wanted, "repeats-compared")
    ddl = "row string, first long, last long"
    usual = _with_bytes(docs, wanted.where(F.col("kinds") <= hot_contexts), length)
    marks = whole.union(usual.repartition("h").sortWithinPartitions("h").mapInArrow(_compared(length), ddl))
    hot = wanted.where(F.col("kinds") > hot_contexts)
    if not hot.isEmpty():
        digests = _with_bytes(docs, hot, length).mapInArrow(_window_digests(length), "w1 long, w2 long, row string, first long, n long")
        digests = stored(digests, "repeats-strings")
        more = digests.groupBy(F.col("w1").alias("of_1"), F.col("w2").alias("of_2")).agg(F.sum("n").alias("total")).where("total > 1")
        found = digests.where("n = 1").join(more, (F.col("w1") == F.col("of_1")) & (F.col("w2") == F.col("of_2")))
        marks = marks.union(found.select("row", "first", F.col("first").alias("last")))
    return marks


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_contexts: int = HOT_CONTEXTS,
) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``spans`` (start and end of the removed runs of bytes)
    and ``kept`` (binary, the other bytes)."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(F.col(id_col), F.col(text_col)).cast("string")).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )
    keyed = rows.select("row", "text")
    spans = (
        repeated_starts(keyed, length, gram, hot_contexts)
        .distinct()
        .groupBy(F.col("row").alias("of_row"))
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("marks"))
    )
    spans = stored(spans, "repeats-spans")

    @F.arrow_udf("struct<spans: array<struct<start: long, end: long>>, n_bytes: long, kept: binary>")
    @tidy
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kind = pa.struct([("spans", pa.list_(span)), ("n_bytes", pa.int64()), ("kept", pa.binary())])
        for batch in pieces(batches):
            out = []
            for text, marks in zip(*(c.to_pylist() for c in batch)):
                data, gone = (text or "").encode("utf-8"), []
                for mark in marks or []:
                    start, end = mark["first"], mark["last"] + length
                    if gone and start <= gone[-1]["end"]:
                        gone[-1]["end"] = max(end, gone[-1]["end"])
                    else:
                        gone.append({"start": start, "end": end})
                edges = [0, *(e for g in gone for e in (g["start"], g["end"])), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append({"spans": gone, "n_bytes": len(data), "kept": kept})
            yield pa.array(out, kind)

    listed = _among(rows, spans, "left_semi").join(spans, F.col("row") == F.col("of_row"), "left")
    marked = listed.select("id", "text", "marks").unionByName(
        _among(rows, spans, "left_anti").select("id", "text", F.lit(None).cast(spans.schema["marks"].dataType).alias("marks"))
    )
    made = marked.select("id", cut("text", "marks").alias("c"))
    return made.select(F.col("id").alias(id_col), "c.n_bytes", "c.spans", "c.kept")
