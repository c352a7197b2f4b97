"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens in blocks of documents. A block keeps each distinct word once and, per
document, the positions of its words as codes. The words of all blocks meet in buckets by their hash; a
bucket encodes each distinct word once and sends the ids back to the blocks, where the codes turn them into
the ids of each document, in order. Words travel packed by block and bucket, so a frequent word costs one
entry per block, however often it occurs.

Decoding joins ids with the token-byte table, which the vocabulary bounds, and concatenates.

Defined cases: null and empty texts have no ids and decode to no bytes; ids of documents, null ones too,
are passed through; repeated rows are returned as often as they come; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import pretokens
from inkveil.llm.shared import stored_by, tidy

#: Bytes of text in a block; a longer text is a block of its own. Larger blocks repeat fewer words and need more
#: memory.
BLOCK_BYTES = 12 << 20
#: Buckets of distinct words; more of them make smaller tasks, not other results.
BUCKETS = 4096
#: Ids that are handed on at a time, and rows decoded at a time.
IDS_PER_BATCH = 1_000_000
DECODED_ROWS = 256
#: Distinct words that a bucket's task remembers before it starts anew.
REMEMBERED = 500_000


class _Codes(dict):
    """Numbers words in the order in which they appear."""

    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes in a byte each if below 255, else 255 and four byte planes elsewhere; deflated."""
    rare = codes[codes >= 255].astype("<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(len(codes).to_bytes(8, "little") + np.minimum(codes, 255).astype(np.uint8).tobytes() + rare.T.tobytes(), 1)


def unpack_codes(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    codes = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    planes = np.frombuffer(raw, np.uint8, -1, 8 + n).reshape(4, -1).astype(np.int64)
    codes[codes == 255] = planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24
    return codes


def pack_lists(lengths: np.ndarray, items: bytes) -> bytes:
    return zlib.compress(len(lengths).to_bytes(4, "little") + lengths.astype("<u4").tobytes() + items, 1)


def unpack_lists(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = zlib.decompress(data)
    count = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u4", count, 4), raw[4 + 4 * count :]


def spelled_out(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """Joins lists of ids with the token-byte table: the bytes of each list, concatenated."""
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.take(table, pc.list_flatten(ids)))
    return pc.binary_join(tokens, pa.scalar(b"", pa.binary()))


def _blocks(pattern: str, block_bytes: int, id_type: pa.DataType, schema: pa.Schema):
    def pack(block: int, ids: list, coded: list[np.ndarray], words: _Codes) -> pa.RecordBatch:
        spelled = [w.encode("utf-8") for w in words]
        bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in spelled), np.int64, len(spelled))
        flat = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        # the most frequent words get the smallest codes
        by_rank = np.argsort(-np.bincount(flat, minlength=len(spelled)), kind="stable")
        rank = np.empty(len(spelled), np.int64)
        rank[by_rank] = np.arange(len(spelled))
        order = by_rank[np.argsort(bucket[by_rank], kind="stable")]
        used, firsts = np.unique(bucket[order], return_index=True)
        packed = []
        for part in np.split(order, firsts[1:]) if len(order) else []:
            own = [spelled[i] for i in part.tolist()]
            packed.append(pack_lists(np.fromiter(map(len, own), np.int64, len(own)), b"".join(own)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([[len(c) for c in coded]], pa.list_(pa.int32())),
                pa.array([pack_codes(rank[flat])], pa.binary()),
                pa.array([zlib.compress(bucket[by_rank].astype("<u2").tobytes(), 1)], pa.binary()),
                pa.array([used.tolist()], pa.list_(pa.int32())),
                pa.array([packed], pa.list_(pa.binary())),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        coded: list[np.ndarray] = []
        words = _Codes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if ids and size + len(text) > block_bytes:
                    yield pack(block, ids, coded, words)
                    block, size, ids, coded, words = block + 1, 0, [], [], _Codes()
                tokens = pretokens.split(text, pattern)
                coded.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                ids.append(doc_id)
                size += len(text)
        if ids:
            yield pack(block, ids, coded, words)

    return tidy(run)


def _encode_words(ranks, pattern: str, width: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pretokens.encoder(ranks.value, pattern)
        known: dict[bytes, bytes] = {}
        bucket = None
        size = np.dtype(width).itemsize
        for batch in batches:
            answers = []
            for own, words in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                if own != bucket or len(known) > REMEMBERED:
                    bucket, known = own, {}
                lengths, spelled = unpack_lists(words.as_py())
                found, at = [], 0
                for n in lengths.tolist():
                    word = spelled[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word), width).tobytes()
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.int64, len(found)) // size
                answers.append(pack_lists(counts, b"".join(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(answers, pa.binary())], schema=schema
            )

    return tidy(run)


def _assemble(width: str, ranks, decoded: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pretokens.token_bytes(ranks.value), pa.binary()) if decoded else None
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1)
                counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, width)]
                answers = block.column("answers").to_pylist()[0] or []
                for answer in sorted(answers, key=lambda a: a["bucket"]):
                    lengths, data = unpack_lists(answer["ids"])
                    counts.append(lengths.astype(np.int64))
                    ids.append(np.frombuffer(data, width))
                del answers
                count, flat = np.concatenate(counts), np.concatenate(ids)
                bucket = np.frombuffer(zlib.decompress(block.column("bucket_of").to_pylist()[0]), "<u2")
                place = np.empty(len(bucket), np.int64)  # where the word of a rank stands among the answers
                place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
                start = np.concatenate(([0], np.cumsum(count)))[:-1]
                codes = place[unpack_codes(block.column("codes").to_pylist()[0])]
                at = 0
                names = block.column("ids").values.slice(block.column("ids").offsets[0].as_py())
                pieces = block.column("lengths").to_pylist()[0]
                done, held, offsets = 0, [], [0]
                for n, length in enumerate(pieces, 1):
                    own = codes[at : at + length]
                    at += length
                    size = count[own]
                    ends = np.cumsum(size)
                    total = int(ends[-1]) if length else 0
                    held.append(flat[np.repeat(start[own] - ends + size, size) + np.arange(total)].astype(np.int32))
                    offsets.append(offsets[-1] + total)
                    if offsets[-1] > IDS_PER_BATCH or n == len(pieces):
                        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(held)))
                        made = [lists, spelled_out(lists, table)] if decoded else [lists]
                        yield pa.RecordBatch.from_arrays([names.slice(done, n - done), *made], schema=schema)
                        done, held, offsets = n, [], [0]

    return tidy(run)


def encode(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: bool = False,
    block_bytes: int | None = None,
) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every document, as tiktoken would encode its whole text.

    With ``decoded``, the ids are decoded where they are assembled, as ``decode`` does for any table of ids.

    ``ranks`` are the contents of a rank file and ``pattern`` its splitting pattern; both are small and
    fixed, so they are broadcast. Special tokens are ordinary text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    width = "<u2" if len(pretokens.token_bytes(ranks)) <= 1 << 16 else "<u4"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def arrow(ddl: str) -> pa.Schema:
        return to_arrow_schema(spark.createDataFrame([], ddl).schema)

    packed = (
        f"block long, ids array<{id_type}>, lengths array<int>, codes binary, bucket_of binary, "
        "buckets array<int>, words array<binary>"
    )
    arrow_id = arrow(f"id {id_type}").field(0).type
    blocks = stored_by(source.mapInArrow(_blocks(pattern, block_bytes or BLOCK_BYTES, arrow_id, arrow(packed)), packed), "block", "bpe_blocks")

    reply = "block long, bucket int, ids binary"
    answers = (
        blocks.select("block", F.explode(F.arrays_zip("buckets", "words")).alias("w"))
        .select("block", F.col("w.buckets").alias("bucket"), F.col("w.words").alias("words"))
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode_words(shared, pattern, width, arrow(reply)), reply)
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "ids")).alias("answers"))
    )
    result = f"id {id_type}, ids array<int>" + ", decoded binary" * decoded
    return (
        blocks.drop("buckets", "words")
        .join(answers, "block", "left")
        .select("block", "ids", "lengths", "codes", "bucket_of", "answers")
        .mapInArrow(_assemble(width, shared, decoded, arrow(result)), result)
        .withColumnRenamed("id", id_col)
    )


def decode(encoded: DataFrame, ranks: bytes, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary): the bytes of the ids, concatenated. Null ids: none."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    @tidy
    def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(pretokens.token_bytes(shared.value), pa.binary())
        for lists in batches:
            for at in range(0, len(lists), DECODED_ROWS):
                part = pc.fill_null(lists.slice(at, DECODED_ROWS), pa.scalar([], lists.type))
                yield spelled_out(part, table)

    return encoded.withColumn("decoded", spell(F.col(ids_col)))
