"""Sharding by fixed virtual slots.

Every record is hashed into one of a few thousand slots, for ever. Rows and bytes are summed per slot, and
a table says which shard holds which slot. The table has versions: rebalancing writes a new version that
moves as few slots as it needs and leaves the others where they are; records never change their slot.

The slot table has a fixed number of rows, whatever the input, so its edits are made on the driver.
The law that holds is ``bytes``: shards are near equal in bytes, up to the weight of a slot's records.

Defined cases: a null text weighs one byte, as empty does, and has the checksum of no bytes; rows with a
null id are spread by their text; rows that are equal in id and text share a slot; a shard without rows
does not occur in the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.shared import shared_path, stored

#: Virtual slots; fixed, as records are bound to them.
SLOTS = 8192
MAP = "version int, vslot int, shard int, slot_rows long, slot_bytes long"


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``id``, ``size``, ``text_crc32`` and ``vslot`` of every record, without its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """Rows and bytes of every slot, empty ones too: a list as long as there are slots."""
    sums = records.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    sizes = [(0, 0)] * slots
    for row in sums.toLocalIterator():
        sizes[row["vslot"]] = (row["n"], row["b"])
    return sizes


def in_turn(slots: int, shards: int) -> list[int]:
    """The shard of each slot before anything is known of the records."""
    return [slot % shards for slot in range(slots)]


def rebalanced(owner: list[int], sizes: list[tuple[int, int]], shards: int) -> list[int]:
    """The map edited for the present sizes and ``shards`` shards, moving few slots.

    Slots of shards that no longer exist move first. Then the heaviest shard gives the lightest one the slot
    that makes the two most equal, until none makes them more equal.
    """
    owner = list(owner)
    held: list[list[int]] = [[] for _ in range(shards)]
    load = [0] * shards
    homeless = []
    for slot, shard in enumerate(owner):
        if shard < shards:
            held[shard].append(slot)
            load[shard] += sizes[slot][1]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-sizes[s][1], s)):
        to = min(range(shards), key=lambda s: (load[s], s))
        held[to].append(slot)
        load[to] += sizes[slot][1]
        owner[slot] = to
    while shards > 1:
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        best = min((s for s in held[high] if 0 < sizes[s][1] < gap), key=lambda s: (abs(2 * sizes[s][1] - gap), s), default=None)
        if best is None:
            return owner
        held[high].remove(best)
        held[low].append(best)
        load[high] -= sizes[best][1]
        load[low] += sizes[best][1]
        owner[best] = low
    return owner


def save_map(spark: SparkSession, path: str, version: int, owner: list[int], sizes: list[tuple[int, int]]) -> None:
    """Adds a version to the stored map; a version once written is never changed."""
    rows = [(version, slot, shard, *sizes[slot]) for slot, shard in enumerate(owner)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version:06d}")


def assigned(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``shard`` and a gapless ``slot`` within the shard for every record.

    A record's place is the number of rows in the shard's earlier virtual slots plus its rank in its own,
    so the ranks are taken in thousands of small groups, not in a group per shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.where("slot_rows > 0").select(
        F.col("vslot").alias("of_vslot"), "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("start")
    )
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size"))
    return (
        records.withColumn("rank", rank.cast("long"))
        .join(F.broadcast(starts), F.col("vslot") == F.col("of_vslot"))  # one row per slot at most
        .withColumn("slot", F.col("start") + F.col("rank") - 1)
    )


def shard(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``virtual_slot``.

    The map is stored at ``map_path``, by default a new folder next to the checkpoints: version 1 deals the slots
    in turn, and version 2, which holds, is its edit for the bytes that the slots turned out to have.
    """
    spark = docs.sparkSession
    path = map_path or shared_path(spark, "shard-map")
    records = stored(placed(docs, id_col, text_col, slots), "shard-records")
    sizes, first = slot_sizes(records, slots), in_turn(slots, shards)
    save_map(spark, path, 1, first, sizes)
    save_map(spark, path, 2, rebalanced(first, sizes, shards), sizes)
    return assigned(records, load_map(spark, path, 2)).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )
