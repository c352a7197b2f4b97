import random
from collections import Counter

import numpy as np
import pytest

from inkveil.llm import repeats


def plain(rows, length):
    """(id, bytes, spans, kept) by counting every string."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[n : n + length] for _, b in texts for n in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for n in range(len(b) - length + 1):
            if seen[b[n : n + length]] > 1:
                gone[n : n + length] = [True] * length
        edges = [n for n in range(len(b) + 1) if (n < len(b) and gone[n]) != (n > 0 and gone[n - 1])]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), list(zip(edges[::2], edges[1::2])), kept))
    return out


def texts(draw):
    letters = "ab é"
    shared = ["".join(draw.choice(letters) for _ in range(n)) for n in (30, 45, 80, 120)]
    out = [None, "", "short", "ab" * 150, "ab" * 150, "x" * 100]
    for _ in range(60):
        parts = [draw.choice(shared)[draw.randint(0, 20) :] if draw.random() < 0.6 else "".join(draw.choice(letters) for _ in range(25)) for _ in range(draw.randint(1, 6))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("segment", "shard", "hot"), [(1 << 20, 1 << 20, 1000), (64, 700, 1000), (1 << 20, 1 << 20, 2)])
def test_against_counting(spark, monkeypatch, segment, shard, hot):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    draw = random.Random(segment + hot)
    rows = list(enumerate(texts(draw))) + [(None, "no id " * 20)]
    rows += [(9, rows[9][1])] * 2
    docs = spark.createDataFrame([(i, t, "r", [0]) for i, t in rows], "doc_id long, text string, row string, spans array<int>").repartition(3)
    made = repeats.remove_repeats(docs, length=40, gram=8, hot_contexts=hot).collect()
    found = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in made]
    assert sorted(map(repr, plain(rows, 40))) == sorted(map(repr, found))


def test_many_anchors_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    rows = list(enumerate(texts(random.Random(4))))
    made = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, gram=8).collect()
    found = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in made]
    assert sorted(map(repr, plain(rows, 40))) == sorted(map(repr, found))


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_common_prefixes(seed):
    draw = random.Random(seed)
    data = bytes(draw.choice(b"ab" if seed % 2 else b"abcdefgh\0") for _ in range(draw.choice([1, 7, 300]))) * draw.choice([1, 3])
    view = np.frombuffer(data, np.uint8)
    order = repeats.suffix_array(view).tolist()
    assert order == sorted(range(len(data)), key=lambda i: data[i:])
    wanted = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while n < 50 and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        wanted.append(n)
    assert repeats.common_prefixes(view, np.array(order), 50, lanes=5).tolist() == wanted


def test_binary_search():
    data = np.frombuffer(b"banana bandana", np.uint8)
    order = repeats.suffix_array(data)
    texts_ = np.frombuffer(b"anabanxyzana", np.uint8)
    low, high = repeats.find(data, order, texts_, np.array([0, 3, 6, 9]), 3)
    assert (high - low).tolist() == [3, 2, 0, 3]
