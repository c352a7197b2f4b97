import random

import public_tokenizers
import pytest
import tiktoken

from inkveil.llm import bpe, counts, pretokens

with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
    RANKS = f.read()
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pretokens.ranks_of(RANKS), special_tokens={})
PARTS = ["the ", " ", "  ", "\n", "'", "'s", "re", "ll", "123", "a", "é", "!!", ".", "ing", " t", "\t", "中", "՘", "Ⅷ", "\U00031350", "<|endoftext|>"]


def drawn(draw, most=60):
    return "".join(draw.choice(PARTS) for _ in range(draw.randint(0, most)))


def test_pretokens_as_the_library():
    draw, encode = random.Random(1), pretokens.encoder(RANKS, PATTERN)
    for _ in range(3000):
        text = drawn(draw, 15) + chr(draw.choice([draw.randrange(32, 0xD800), draw.randrange(0xE000, 0x110000)]))
        words = pretokens.split(text, PATTERN)
        assert "".join(words) == text
        assert [i for w in words for i in encode(w.encode())] == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("block_bytes", [50, bpe.BLOCK_BYTES])
def test_encode_and_decode(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block_bytes)
    draw = random.Random(2)
    texts = [None, "", " ", "x" * 30_000, "word " * 20_000, *(drawn(draw) for _ in range(40))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "b", [1]) for i, t in rows], "doc_id long, text string, block string, ids array<int>").repartition(3)
    made = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).collect()
    both = bpe.encode(docs, RANKS, PATTERN, decoded=True).collect()
    assert sorted(map(repr, map(tuple, both))) == sorted(map(repr, map(tuple, made)))
    wanted = [(i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(map(repr, wanted)) == sorted(repr((r.doc_id, r.ids, bytes(r.decoded))) for r in made)


def test_encode_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).count() == 0


@pytest.mark.parametrize("block", [2, 128])
def test_tree_edits(monkeypatch, block):
    monkeypatch.setattr(counts, "BLOCK", block)
    draw, counter = random.Random(block), counts.Counter(pretokens.encoder(RANKS, PATTERN))
    for _ in range(400):
        text = drawn(draw)
        tree = counts.Tree.of(text, PATTERN, counter)
        for _ in range(draw.randint(1, 6)):
            pos, gone, new = draw.randint(-1, len(text) + 2), draw.choice([0, 0, 1, 2, 5, 30]), drawn(draw, draw.choice([0, 1, 20]))
            if draw.random() < 0.3:
                tree = counts.Tree.unpacked(tree.packed())
            start = min(max(pos, 0), len(text))
            wanted = text[:start] + new + text[min(start + gone, len(text)) :]
            text, _ = tree.edit(text, pos, gone, new, PATTERN, counter)
            assert text == wanted
            assert [n for own in tree.lengths for n in own.tolist()] == [len(w) for w in pretokens.split(text, PATTERN)]
            assert tree.total == len(LIBRARY.encode_ordinary(text))


def test_an_edit_encodes_few_pretokens():
    counter = counts.Counter(pretokens.encoder(RANKS, PATTERN))
    text = "some words of a text, " * 5000
    tree = counts.Tree.of(text, PATTERN, counter)
    _, encoded = tree.edit(text, 50_000, 3, "new words", PATTERN, counter)
    assert encoded < 10


def test_apply_edits(spark, monkeypatch):
    monkeypatch.setattr(counts, "EDITS_PER_ROUND", 2)
    rows = [(1, "some text here"), (2, None), (3, ""), (None, "no id"), (4, "kept"), (1, "second row")]
    docs = spark.createDataFrame([(i, t, 0, "t") for i, t in rows], "doc_id long, text string, n_tokens int, tree string")
    edits = [(1, 2, 0, 4, None), (1, 1, 4, 0, " more"), (1, 3, None, None, "First: "), (2, 1, 5, 5, "added"), (3, 1, -3, -3, "x"), (9, 1, 0, 0, "?"), (None, 1, 0, 0, "?")]
    table = spark.createDataFrame(edits, "doc_id long, seq long, pos long, deleted long, inserted string")
    made = counts.apply_edits(counts.build(docs, RANKS, PATTERN), table, RANKS, PATTERN).collect()
    wanted = [(1, "First:  more text here"), (2, "added"), (3, "x"), (None, "no id"), (4, "kept"), (1, "First:  morend row")]
    assert sorted(map(repr, wanted)) == sorted(repr((r.doc_id, r.text)) for r in made)
    assert all(r.n_tokens == len(LIBRARY.encode_ordinary(r.text)) for r in made)


def test_apply_no_edits(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, seq long, pos long, deleted long, inserted string")
    assert [tuple(r)[:2] for r in counts.apply_edits(counts.build(docs, RANKS, PATTERN), none, RANKS, PATTERN).collect()] == [(1, "a b")]
    assert counts.apply_edits(counts.build(docs.limit(0), RANKS, PATTERN), none, RANKS, PATTERN).count() == 0
