import itertools
import random
import re

import pytest
import xxhash

from inkveil.llm import simhash
from inkveil.llm.components import components
from inkveil.llm.shared import stored


def plain_fingerprint(text, size=3, seed=42):
    words = []
    for word in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" "):
        if word:
            words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, k):
    """Components of (id, fingerprint) over all pairs."""
    least = {i: i for i in range(len(rows))}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (rows[a][1] ^ rows[b][1]).bit_count() <= k:
            least[max(root(a), root(b))] = min(root(a), root(b))
    ids = {}
    for n, (doc_id, _) in enumerate(rows):
        known = [i for i in (ids.get(root(n)), doc_id) if i is not None]
        ids[root(n)] = min(known, default=None)
    return [ids[root(n)] for n in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "Ä Ö Ü É", "a\x0bb\x0cc d e", "x " * 4000, "É a b c d E F"])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text, 3, 42) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("hot", [256, 3])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_links_are_all_pairs_within_distance(spark, hot, k):
    draw = random.Random(k)
    base = [draw.getrandbits(64) for _ in range(20)] + [0]
    fps = set(base)
    for fp in base:
        for _ in range(6):
            for bit in draw.sample(range(64), draw.randint(1, 4)):
                fp ^= 1 << bit
            fps.add(fp)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    found = {(r.src, r.dst) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), k, hot).collect()}
    wanted = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= k}
    assert found == wanted


def inner_joins(df):
    return re.findall(r"(\w+Join) \[.*\], Inner", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("hot", [256, 1])
def test_variants_are_never_broadcast(spark, hot):
    fps = stored(spark.createDataFrame([(i,) for i in range(8)], "fp long"), "test-fps")
    found = simhash.links(fps, 2, hot)
    # the joins of variants with variants; only the counted hot keys may be broadcast
    assert inner_joins(found) == ["SortMergeJoin"] * (1 if hot == 256 else 2)
    assert found.count() == 24  # all pairs but the four of complements in three bits


def test_near_duplicates_broadcast_no_documents(spark):
    made = simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"))
    assert inner_joins(made) == ["SortMergeJoin"] * 2


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    long = [draw.choice(words) for _ in range(300)]
    texts = [None, "", "  ", "A b", "a B", " ".join(long), " ".join(long)]
    for _ in range(25):
        copy = list(long)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(len(copy))] = "new"
        texts.append(" ".join(copy))
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    rows += [(5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    made = simhash.near_duplicates(docs)
    assert made.columns == ["doc_id", "fingerprint", "component_id"]
    marks = [(i, plain_fingerprint(t)) for i, t in rows]
    wanted = [(i, f"{f:016x}", c) for (i, f), c in zip(marks, plain_components(marks, 2))]
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in made.collect())


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    made = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert made == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
