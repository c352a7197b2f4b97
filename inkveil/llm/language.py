"""Language identification by partial matching.

Per language a tree of byte contexts is counted: after each context of up to ``order`` bytes, how often each
byte followed. A byte seen after the context costs ``-log2(count / (total + kinds))``; any other byte costs an
escape, ``-log2(kinds / (total + kinds))``, and is then coded after the context that is one byte shorter; a
context that was never seen costs nothing to leave. Below the empty context all 256 bytes are alike. The
statistics are frozen, so the cost of a byte depends on the bytes before it only, and a text's code length is
a sum. The language with the shortest code wins; the score is its posterior under equal priors.

The trees of all languages are laid over each other: the grams of one length that any language has seen are
numbered, a table leads from a gram's number and the next byte to the number of the longer gram, and a
second one holds the costs per language. So a text is scored by array look-ups, a few per byte.

The training sample has up to ``sample_bytes`` per language: its different texts in the order of a hash, each
once, until the bound is reached, the last one cut to what is left. So every language with a text is learned,
and copies take no other text's place. All texts are scored whole.

Defined cases: a null text and one without a letter are ``und`` with score zero; rows without a language, a
text or, when training, with an empty text are not learned from; of equal code lengths the
smallest language name wins; without anything to learn from, all texts are ``und``; repeated rows are returned
as often as they come; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.shared import small, stored, tidy

ORDER = 3
#: Bytes of text per language to learn from.
SAMPLE_BYTES = 4 << 20
#: Bytes scored at a time.
PIECE = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``symbol``: the number of each byte value, zero for unseen ones. ``step[k]``: from the number of a
    gram of ``k`` bytes and the next symbol to that of the gram of ``k + 1`` bytes. ``cost[k]``: bits of the
    last byte of a gram of ``k + 1`` bytes, per language. ``escape[k]``: bits to leave a context of ``k``
    bytes, per language. Number zero is any unseen gram; it costs nothing to leave."""

    languages: tuple[str, ...]
    order: int
    symbol: np.ndarray
    step: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]


def gram_counts(sample: DataFrame, order: int) -> DataFrame:
    """``lang``, ``gram`` (1 to ``order + 1`` bytes) and ``n`` over the whole sample (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(text, np.uint8).astype(np.int64)
                for size in range(1, order + 2):
                    keys = np.zeros(max(len(data) - size + 1, 0), np.int64)
                    for i in range(size):
                        keys = keys << 8 | data[i : i + len(keys)]
                    grams, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([lang] * len(grams), pa.string()), "size": pa.array([size] * len(grams), pa.int32()),
                         "gram": pa.array(grams, pa.int64()), "n": pa.array(n, pa.int64())}
                    )

    found = sample.select("lang", F.col("text").cast("binary")).mapInArrow(tidy(count), "lang string, size int, gram long, n long")
    return found.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def frozen(counts: pa.Table, order: int = ORDER) -> Model:
    """The model of the gram counts, whose number the sample bounds."""
    lang = counts.column("lang").to_numpy(zero_copy_only=False)
    size, gram, n = (counts.column(c).to_numpy() for c in ("size", "gram", "n"))
    languages = tuple(sorted(set(lang)))
    at = np.searchsorted(np.array(languages, dtype=object), lang) if languages else np.zeros(0, np.int64)
    seen = np.unique(gram[size == 1])
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    tables = []  # counts per gram length: sorted grams x languages
    for k in range(1, order + 2):
        own = size == k
        grams, row = np.unique(gram[own], return_inverse=True)
        table = np.zeros((len(grams), len(languages)))
        table[row, at[own]] = n[own]
        tables.append((grams, table))
    step, cost, escape = [], [], []
    below = np.full((1, len(languages)), 8.0)  # bits of a byte after the context that is one shorter
    parents = np.zeros(1, np.int64)  # the sorted contexts of this length; the empty one first
    for grams, table in tables:
        context = np.searchsorted(parents, grams >> 8) if len(step) else np.zeros(len(grams), np.int64)
        total, kinds = np.zeros((2, len(parents), len(languages)))
        np.add.at(total, context, table)
        np.add.at(kinds, context, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            code = -np.log2(table / (total + kinds)[context])
        # the same byte after the shorter context: the gram without its first byte
        if step:
            shorter = below[1 + np.searchsorted(previous, grams & ((1 << 8 * len(step)) - 1))]
        else:
            shorter = np.broadcast_to(below, code.shape)
        code = np.where(table > 0, code, leave[context] + shorter)
        leads = np.zeros((len(parents) + bool(step), width), np.int32)
        leads[context + bool(step), symbol[grams & 0xFF]] = np.arange(1, len(grams) + 1)
        step.append(leads)
        cost.append(np.concatenate((np.zeros((1, len(languages))), code)).astype(np.float32))
        escape.append((np.concatenate((np.zeros((1, len(languages))), leave)) if len(escape) else leave).astype(np.float32))
        below, parents, previous = np.concatenate((np.zeros((1, len(languages))), code)), grams, grams
    return Model(languages, order, symbol.astype(np.int32), step, cost, escape)


def code_lengths(model: Model, data: np.ndarray) -> np.ndarray:
    """Bits of a text's bytes in each language."""
    bits = np.zeros(len(model.languages))
    for start in range(0, len(data), PIECE):
        lead = min(start, model.order)
        symbols = model.symbol[data[start - lead : start + PIECE]]
        numbers = []  # of the grams that end at each byte, by length
        for k, leads in enumerate(model.step):
            before = np.zeros(len(symbols), np.int32)
            if k:
                before[1:] = numbers[-1][:-1]
            numbers.append(leads[before, symbols])
        # from the longest gram down: whoever is unseen pays its context's escape and goes on
        open_ = np.arange(lead, len(symbols))
        for k in range(model.order, -1, -1):
            number = numbers[k][open_]
            hit = number > 0
            bits += np.bincount(number, minlength=len(model.cost[k])) @ model.cost[k].astype(np.float64)
            open_ = open_[~hit]
            if k == 0:
                left = np.zeros(len(open_), np.int64)
            else:
                left = np.where(open_ > 0, numbers[k - 1][open_ - 1], 0)
            bits += np.bincount(left, minlength=len(model.escape[k])) @ model.escape[k].astype(np.float64)
        bits += 8.0 * len(open_)
    return bits


def drawn(rows: DataFrame, sample_bytes: int) -> DataFrame:
    """``lang`` and ``text`` (bytes) of the different texts of ``rows`` in hash order, up to ``sample_bytes`` a language."""
    rows = rows.withColumn("key", F.xxhash64("lang", "text"))
    part = F.shiftrightunsigned("key", 48)  # the first 16 bits
    sizes = rows.groupBy("lang", "key").agg(F.max(F.octet_length("text").cast("long")).alias("size"))
    sizes = stored(sizes.withColumn("part", part), "language-texts")

    def ahead(*order: str):
        return Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def before(size: str, *order: str):
        return F.coalesce(F.sum(size).over(ahead(*order)), F.lit(0))

    # texts are put in order only where the bound may be reached: a window never holds a whole language
    parts = sizes.groupBy("lang", "part").agg(F.sum("size").alias("bytes")).withColumn("before", before("bytes", "part"))
    # sorted, as Spark takes the texts' keys to be few by the size of their files
    near = sizes.hint("merge").join(parts.where(F.col("before") < sample_bytes).drop("before", "bytes"), ["lang", "part"])
    left = (sample_bytes - before("size", "part", "key")).cast("int")
    chosen = near.select(F.col("key").alias("chosen"), left.alias("left")).where("left > 0")
    chosen = small(stored(chosen, "language-sample"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            new = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]
            if new:
                yield batch.take(pa.array(new, pa.int64()))

    texts = rows.join(chosen, F.col("key") == F.col("chosen")).select(
        "key", "lang", F.substring(F.col("text").cast("binary"), F.lit(1), F.col("left")).alias("text")
    )
    # copies go in the task that reads them, so that few are shuffled
    return texts.mapInArrow(tidy(once), "key long, lang string, text binary").dropDuplicates(["key"]).drop("key")


def learn(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """The model of a bounded sample of ``docs``, which are all labelled."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sample = drawn(rows.where("lang is not null and octet_length(text) > 0"), sample_bytes)
    return frozen(stored(gram_counts(sample, order), "language-counts").toArrow(), order)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from their texts alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    @tidy
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        letter, own = regex.compile(r"\p{L}"), shared.value
        for texts in batches:
            names, scores = [], []
            for text in texts:
                text = text.as_py()
                if text is None or not own.languages or not letter.search(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bits = code_lengths(own, np.frombuffer(text.encode("utf-8"), np.uint8))
                least = int(np.argmin(bits))
                names.append(own.languages[least])
                scores.append(float(1 / np.exp2(np.maximum(bits[least] - bits, -1000)).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    made = docs.withColumn("_language", best(F.col(text_col).cast("string")))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return made.select(*kept, "_language.lang_pred", "_language.score")
