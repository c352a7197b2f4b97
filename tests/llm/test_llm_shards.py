import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from inkveil.llm import shards
from inkveil.llm.shared import shared_path

ROWS = [(i, "word " * (i % 37)) for i in range(400)] + [(None, None), (None, "x"), (7, "again"), (8, "again"), (9, ""), (9, "")]


def test_shard(spark):
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in ROWS], "doc_id long, text string, shard string, slot int")
    made = shards.shard(docs, shards=8, slots=512).collect()
    found = sorted((r.doc_id or -1, r.size, r.text_crc32) for r in made)
    assert found == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    by = defaultdict(list)
    for r in made:
        by[r.shard].append(r)
    assert set(by) == set(range(8))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    sizes = [sum(r.size for r in rows) for rows in by.values()]
    assert max(sizes) - min(sizes) <= max(r.size for r in made)
    assert {(r.law, r.grown_shard) for r in made} == {("bytes", None)}


def test_empty(spark):
    assert shards.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_versions_move_few_slots(spark):
    records = shards.placed(spark.createDataFrame(ROWS, "doc_id long, text string"), slots=512)
    sizes = shards.slot_sizes(records, 512)
    first = shards.rebalanced(shards.in_turn(512, 8), sizes, 8)
    grown = shards.rebalanced(first, sizes, 9)
    load = [sum(b for s, (_, b) in zip(grown, sizes) if s == shard) for shard in range(9)]
    assert max(load) - min(load) <= max(b for _, b in sizes)
    moved = [(a, b) for a, b in zip(first, grown) if a != b]
    assert 0 < sum(1 for _ in moved) < 512 / 4
    shrunk = shards.rebalanced(grown, sizes, 8)
    assert set(shrunk) <= set(range(8))
    path = shared_path(spark, "test-map")
    shards.save_map(spark, path, 1, first, sizes)
    shards.save_map(spark, path, 2, grown, sizes)
    assert [r.shard for r in shards.load_map(spark, path, 1).orderBy("vslot").collect()] == first
    placed = shards.assigned(records, shards.load_map(spark, path, 2))
    assert placed.agg(F.countDistinct("shard", "slot")).first()[0] == len(ROWS)


def test_the_stored_map_is_edited(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    made = shards.shard(docs, shards=8, slots=512, map_path=str(tmp_path / "map"))
    before, after = ({r.vslot: r.shard for r in shards.load_map(spark, str(tmp_path / "map"), v).collect()} for v in (1, 2))
    assert before == {slot: slot % 8 for slot in range(512)}
    assert 0 < sum(before[slot] != after[slot] for slot in before) < 512 / 4
    assert all(after[r.virtual_slot] == r.shard for r in made.collect())
