"""Edit-aware token counts.

A document's tree has its pre-tokens as leaves, in blocks, each with its length in characters and its number
of tokens; the nodes above hold the sums. An edit finds the pre-tokens it touches by descending the sums and
cuts the text anew from there. A pre-token depends on its own characters and the two after it, so those that
end two characters before the edit stay as they are; to the right, cutting ends as soon as a new boundary
meets an old one behind the edit, since all that follows is cut alike. Only the pre-tokens in between are
encoded, and only the sums above their blocks are changed. The count of the document is the root.

Edits of a document are applied in the order of ``seq``, each to the text that the one before has left.

Defined cases: a null text is empty; positions and lengths beyond the text are cut to it, negative ones are
zero and null ones too; a null insertion inserts nothing; edits for documents that are not there are ignored;
documents without edits keep their counts; rows with a null id have no edits; of edits with one ``seq``, the
order is by position, then by deleted length, then by insertion; rows that share an id all get its edits; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm import pretokens
from inkveil.llm.shared import pieces, stored, tidy

#: Pre-tokens in a block of leaves when a tree is built; a block of four times as many splits the tree anew.
BLOCK = 128
#: Edits of a document that are gathered at a time.
EDITS_PER_ROUND = 4096
#: Distinct pre-tokens whose counts a task remembers.
REMEMBERED = 500_000
EDIT = "struct<seq: long, pos: long, deleted: long, inserted: string>"


class Counter(dict):
    """The number of tokens of each pre-token."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode = encode

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self[word] = len(self.encode(word.encode("utf-8")))
        return n


class Tree:
    """Pre-token lengths and counts in blocks under two segment trees of sums."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None):
        if sizes is None:
            cuts = np.arange(BLOCK, len(lengths), BLOCK)
        else:
            cuts = np.cumsum(sizes)[:-1]
        self.lengths = np.split(lengths.astype(np.int64), cuts)
        self.counts = np.split(counts.astype(np.int64), cuts)
        self.leaves = 1 << max(len(self.lengths) - 1, 0).bit_length()
        self.chars = np.zeros(2 * self.leaves, np.int64)
        self.tokens = np.zeros(2 * self.leaves, np.int64)
        for sums, blocks in ((self.chars, self.lengths), (self.tokens, self.counts)):
            sums[self.leaves : self.leaves + len(blocks)] = [b.sum() for b in blocks]
            level = self.leaves
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
                level //= 2

    @classmethod
    def of(cls, text: str, pattern: str, counter: Counter) -> Tree:
        words = pretokens.split(text, pattern)
        return cls(
            np.fromiter(map(len, words), np.int64, len(words)),
            np.fromiter(map(counter.__getitem__, words), np.int64, len(words)),
        )

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def packed(self) -> bytes:
        sizes = np.fromiter(map(len, self.lengths), "<u4", len(self.lengths))
        lengths, counts = np.concatenate(self.lengths), np.concatenate(self.counts)
        return b"".join((len(sizes).to_bytes(4, "little"), sizes.tobytes(), lengths.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        blocks = int.from_bytes(data[:4], "little")
        sizes = np.frombuffer(data, "<u4", blocks, 4)
        n = int(sizes.sum())
        lengths = np.frombuffer(data, "<u4", n, 4 + 4 * blocks)
        return cls(lengths, np.frombuffer(data, "<u4", n, 4 + 4 * blocks + 4 * n), sizes)

    def _find(self, chars: int) -> tuple[int, int, int]:
        """Block, place in it and offset of the first pre-token that ends after ``chars`` characters."""
        node, offset = 1, 0
        while node < self.leaves:
            node *= 2
            if offset + self.chars[node] <= chars:
                offset += int(self.chars[node])
                node += 1
        block = min(node - self.leaves, len(self.lengths) - 1)
        if node - self.leaves != block:  # behind the last one
            return block, len(self.lengths[block]), int(self.chars[1])
        ends = offset + np.cumsum(self.lengths[block])
        place = int(np.searchsorted(ends, chars, "right"))
        return block, place, int(ends[place - 1]) if place else offset

    def _set(self, block: int) -> None:
        node = block + self.leaves
        self.chars[node], self.tokens[node] = self.lengths[block].sum(), self.counts[block].sum()
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def edit(self, text: str, pos: int, deleted: int, inserted: str, pattern: str, counter: Counter) -> tuple[str, int]:
        """The text after the edit, and the number of pre-tokens that were encoded for it."""
        start = min(max(pos, 0), len(text))
        end = min(start + max(deleted, 0), len(text))
        after = text[:start] + inserted + text[end:]
        shift = len(after) - len(text)
        # keep what ends at least two characters before the edit
        block, place, offset = self._find(start - 2) if start >= 2 else (0, 0, 0)
        old_block, old_place, old_end = block, place, offset
        lengths, counts, new_end = [], [], offset
        last = len(self.lengths) - 1

        def skip_to(limit: int) -> None:
            """Moves over old pre-tokens until one ends at ``limit`` or later."""
            nonlocal old_block, old_place, old_end
            while old_end < limit:
                if old_place == len(self.lengths[old_block]):
                    if old_block == last:
                        return
                    old_block, old_place = old_block + 1, 0
                    continue
                old_end += int(self.lengths[old_block][old_place])
                old_place += 1

        skip_to(end)
        if not (new_end == len(after) or (new_end >= start + len(inserted) and old_end + shift == new_end)):
            for match in pretokens.splitter(after, pattern).finditer(after, offset):
                word = match[0]
                lengths.append(len(word))
                counts.append(counter[word])
                new_end = match.end()
                if new_end >= start + len(inserted):
                    skip_to(new_end - shift)
                    if old_end + shift == new_end:
                        break
        if new_end == len(after):
            old_block, old_place = last, len(self.lengths[last])
        rest_l, rest_c = self.lengths[old_block][old_place:], self.counts[old_block][old_place:]
        for i in range(block + 1, old_block + 1):
            self.lengths[i], self.counts[i] = rest_l[:0], rest_c[:0]
            self._set(i)
        self.lengths[block] = np.concatenate((self.lengths[block][:place], np.array(lengths, np.int64), rest_l))
        self.counts[block] = np.concatenate((self.counts[block][:place], np.array(counts, np.int64), rest_c))
        self._set(block)
        if len(self.lengths[block]) > 4 * BLOCK:
            self.__init__(np.concatenate(self.lengths), np.concatenate(self.counts))
        return after, len(lengths)


def _per_task(shared, pattern: str) -> Counter:
    return Counter(pretokens.encoder(shared.value, pattern))


def tree_of(text: Column, shared, pattern: str) -> Column:
    """The packed tree of a text."""

    @F.arrow_udf("binary")
    @tidy
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _per_task(shared, pattern)
        for texts in pieces(batches):
            yield pa.array([Tree.of(t.as_py() or "", pattern, counter).packed() for t in texts], pa.binary())

    return build(text)


def edited(text: Column, tree: Column, edits: Column, shared, pattern: str) -> Column:
    """Struct of ``before``, ``text``, ``tree``, ``n_tokens`` and ``encoded`` after an array of edits in order."""

    @F.arrow_udf("struct<before: long, text: string, tree: binary, n_tokens: long, encoded: long>")
    @tidy
    def apply(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        counter = _per_task(shared, pattern)
        kind = pa.struct([("before", pa.int64()), ("text", pa.string()), ("tree", pa.binary()), ("n_tokens", pa.int64()), ("encoded", pa.int64())])
        for batch in pieces(batches):
            rows = []
            for text, packed, edits in zip(*batch):
                text, own, encoded = text.as_py() or "", Tree.unpacked(packed.as_py()), 0
                before = own.total
                for e in edits.as_py() or []:
                    text, n = own.edit(text, e["pos"] or 0, e["deleted"] or 0, e["inserted"] or "", pattern, counter)
                    encoded += n
                rows.append({"before": before, "text": text, "tree": own.packed(), "n_tokens": own.total, "encoded": encoded})
            yield pa.array(rows, kind)

    return apply(text, tree, edits)


def build(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text`` and ``tree`` of every document: the state that edits are applied to."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("text"))
    return rows.withColumn("tree", tree_of(F.col("text"), shared, pattern))


def apply_edits(trees: DataFrame, edits: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``text``, ``tree``, ``n_tokens``, ``encoded`` after all ``edits`` (``id_col``, ``seq``,
    ``pos``, ``deleted``, ``inserted``). A document with very many edits gets them in rounds."""
    shared = trees.sparkSession.sparkContext.broadcast(ranks)
    order = Window.partitionBy(id_col).orderBy("seq", "pos", "deleted", "inserted")
    numbered = stored(
        edits.where(F.col(id_col).isNotNull())
        .select(F.col(id_col), *(F.col(c).cast(t).alias(c) for c, t in (("seq", "long"), ("pos", "long"), ("deleted", "long"), ("inserted", "string"))))
        .withColumn("round", F.floor((F.row_number().over(order) - 1) / EDITS_PER_ROUND))
        .withColumn("nth", F.row_number().over(order)),
        "edits",
    )
    rounds = (numbered.agg(F.max("round")).first()[0] or 0) + 1
    state = trees.select(id_col, "text", "tree", F.lit(0).cast("long").alias("encoded"))
    for n in range(rounds):
        own = numbered.where(F.col("round") == n).groupBy(F.col(id_col).alias("of_id"))
        own = own.agg(F.sort_array(F.collect_list(F.struct("nth", "seq", "pos", "deleted", "inserted"))).alias("edits"))
        joined = state.join(own, F.col(id_col) == F.col("of_id"), "left")
        done = joined.select(id_col, "encoded", edited(F.col("text"), F.col("tree"), F.col("edits"), shared, pattern).alias("e"))
        state = done.select(id_col, "e.text", "e.tree", "e.n_tokens", (F.col("encoded") + F.col("e.encoded")).alias("encoded"))
        if n + 1 < rounds:
            state = stored(state, "edited")
    return state
