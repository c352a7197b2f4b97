import random

import numpy as np

from inkveil.llm import decontaminate

WORDS = [f"w{i}" for i in range(400)]


def plain_tiles(item, text, least):
    """Greedy string tiling by looking at every pair of places; the length of each tile."""
    marked_i, marked_t, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and p + n not in marked_i and t + n not in marked_t:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        if best[0] < least:
            return out
        n, p, t = best
        out.append(n)
        marked_i |= set(range(p, p + n))
        marked_t |= set(range(t, t + n))


def test_tiles_against_every_pair():
    draw = random.Random(3)
    for _ in range(150):
        item = [draw.randint(1, 12) for _ in range(draw.randint(1, 60))]
        text = [draw.randint(1, 12) for _ in range(draw.randint(1, 40))]
        for _ in range(draw.randint(0, 3)):
            at, n = draw.randrange(len(item)), draw.randint(1, 30)
            text[draw.randrange(len(text)) :] += item[at : at + n]
        made = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        for p, t, n in made:
            assert item[p : p + n] == text[t : t + n]
        for k in (0, 1):
            used = [i for tile in made for i in range(tile[k], tile[k] + tile[2])]
            assert len(used) == len(set(used))
        lengths = sorted((n for _, _, n in made), reverse=True)
        assert lengths[:1] == sorted(plain_tiles(item, text, 3), reverse=True)[:1]


def passages(seed, count, size=30):
    draw = random.Random(seed)
    return [[draw.choice(WORDS) for _ in range(size)] for _ in range(count)]


def test_planted_passages(spark):
    items = passages(1, 12)
    noise = passages(2, 40, 200)
    rows = [(i, " ".join(n)) for i, n in enumerate(noise)]
    exact = " ".join(items[0])
    pieces = items[1][20:] + ["between"] * 3 + items[1][10:20] + ["and"] + items[1][:10]  # reordered
    half = items[2][:10]
    rows += [
        (100, f"before {exact} after"), (101, exact.upper().replace(" ", ", ")), (102, " ".join(pieces)), (103, " ".join(half)),
        (104, None), (105, ""), (None, exact), (106, f"{exact} {' '.join(items[3])}"), (107, exact), (107, exact),
        (108, "again " * 5000 + exact),
    ]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, seed string, item_id int")
    bench = [(i, " ".join(t), 1) for i, t in enumerate(items)] + [(50, None, 1), (51, "too short", 1), (0, exact, 1), (None, "again " * 30, 1)]
    made = decontaminate.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string, key int"))
    found = sorted((repr((r.doc_id, r.item_id)), r.covered) for r in made.collect())
    wanted = [(100, 0, 30), (101, 0, 30), (102, 1, 30), (None, 0, 30), (106, 0, 30), (106, 3, 30), (107, 0, 30), (108, 0, 30), (108, None, 30)]
    assert found == sorted((repr(w[:2]), w[2]) for w in wanted)


def test_small_map_only_costs_time(spark, monkeypatch):
    items, noise = passages(1, 12), passages(2, 20, 200)
    rows = [(i, " ".join(n)) for i, n in enumerate(noise)] + [(100, " ".join(items[4]))]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "MAP_BITS", 7)
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.contaminated(docs, bench).collect()] == [(100, 4, 1.0)]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 1


def test_short_items_and_scripts_without_spaces(spark):
    han = "学而时习之，不亦说乎有朋自远方来，不亦乐乎人不知而不愠"
    thai = "ภาษาไทยเป็นภาษาที่ไม่เว้นวรรค"
    bench = [(1, "Forty-two!"), (2, "one"), (3, han), (4, thai), (5, "乐乎"), (6, "…"), (7, "a b c d e f")]
    rows = [
        (1, "it is forty, two"), (2, "forty and two"), (3, "ONE for all"), (4, f"前面{han[3:18]}后面"), (5, f"กก{thai}ขข"),
        (6, "乐"), (7, "…"), (8, "a b c d"), (9, "x b c d e f one forty two"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = decontaminate.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): (r.tiles, r.covered, r.item_words) for r in made}
    assert sorted(found) == [(1, 1), (3, 2), (4, 3), (5, 4), (9, 1), (9, 2), (9, 7)]
    assert found[1, 1] == (1, 2, 2) and found[9, 7] == (1, 5, 6) and found[4, 3] == (1, 13, 25)
    assert found[5, 4][1] == found[5, 4][2]
