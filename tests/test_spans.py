"""Span expressions against a plain statement of the same rules, many random texts per job."""

import random

import pytest

from pyspark.sql import functions as F

from inkveil.functions import spans
from inkveil.functions.patterns import PATTERNS, find_structured
from tests import model

PIECES = [
    "1", "13", "138", "12345678901234567", "110101199001011234", "13812345678", "6222021234567890",
    "X", "x", "a", "b.c", "@", "@b.com", "a@b.co", ".", "-", "_%+", " ", "\n", "张三", "电话", "😀", "٣", "９", "é", "",
]


def random_text(rng, size):
    parts = []
    for _ in range(rng.randrange(size)):
        pick = rng.random()
        if pick < 0.4:
            parts.append(rng.choice(PIECES))
        elif pick < 0.7:
            parts.append("".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 40))))
        else:
            parts.append("".join(rng.choice("ab.@-1") for _ in range(rng.randrange(1, 12))))
    return "".join(parts)


def test_structured_equals_plain_rules(spark):
    rng = random.Random(1)
    texts = [random_text(rng, 14) for _ in range(3000)] + ["", "1" * 35, "1" * 36 + "X", "13812345678@qq.com"]
    texts.append(" ".join(random_text(rng, 14) for _ in range(2000)))  # folds over many blocks
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", find_structured("text").alias("items")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert [tuple(x) for x in row["items"]] == model.structured(texts[row["id"]]), texts[row["id"]][:200]


def test_linear_email_pattern_equals_plain_one(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1.@-_ é") for _ in range(rng.randrange(60))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    email = next(p for p in PATTERNS if p.type == "email")
    plain = spans.find_spans("text", model.PATTERNS[3][1])
    differing = df.where(F.col("id") >= 0).select(
        spans.find_spans("text", email.regex).alias("a"), plain.alias("b")
    ).where("a <> b")
    assert differing.count() == 0


def test_long_run_without_at_sign_is_searched_in_linear_time(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 1_000_000), F.lit(" x@y.com")).alias("text"))
    items = df.select(find_structured("text").alias("i")).first()["i"]
    assert [x["value"] for x in items] == ["x@y.com"]


def test_many_items_in_one_text(spark):
    df = spark.range(1).select(F.repeat(F.lit("13812345678,a@b.com;"), 20_000).alias("text"))
    items = df.select(find_structured("text").alias("items"), "text")
    edits = "transform(items, x -> named_struct('start_pos', x.start_pos, 'end_pos', x.end_pos, 'new_value', '*'))"
    row = items.select(F.size("items").alias("n"), spans.splice_text("text", edits).alias("t")).first()
    assert row["n"] == 40_000
    assert row["t"] == "*,*;" * 20_000


def test_long_runs_of_digits(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789") for _ in range(n)) + tail for n in (1500, 1501, 1511, 1519, 30_000) for tail in ("", "X", "@a.com")]
    texts.append("".join(rng.choice("0123456789" * 4 + "X@.c") for _ in range(20_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in df.select("id", find_structured("text").alias("items")).collect():
        assert [tuple(x) for x in row["items"]] == model.structured(texts[row["id"]])


def random_items(rng, n):
    items = []
    for _ in range(n):
        start = rng.randrange(30)
        items.append((start, start + rng.randrange(0, 8), "t", str(rng.random()), rng.choice([0.5, 0.8, 1.0])))
    return items


def test_merge_equals_full_scan(spark):
    rng = random.Random(3)
    cases = [random_items(rng, rng.randrange(9)) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(cases)), f"id int, items array<{spans.ITEM}>")
    for row in df.select("id", spans.merge_items("items").alias("m")).collect():
        assert [tuple(x) for x in row["m"]] == model.merge(cases[row["id"]]), cases[row["id"]]


def test_splice_keeps_the_gaps_and_puts_the_values_between_them(spark):
    rng = random.Random(4)
    cases = []
    for i in range(4000):
        size = rng.choice([5, 40, 9000]) if i % 40 == 0 else rng.choice([5, 40])
        text = "".join(rng.choice("ab😀张\n") for _ in range(rng.randrange(1, size)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(5))))
        edits = [(a, b, rng.choice(["", "#", "<new>", "<<longer>>"])) for a, b in zip(cuts[::2], cuts[1::2])]
        rng.shuffle(edits)
        cases.append((i, text, edits))
    df = spark.createDataFrame(cases, f"id int, text string, edits array<{spans.EDIT}>")
    for row in df.select("id", spans.splice_text("text", "edits").alias("r")).collect():
        assert row["r"] == model.spliced_disjoint(*cases[row["id"]][1:]), cases[row["id"]]


def test_splice_of_overlapping_edits(spark):
    """Worked by hand: the higher start first, the lower one on its result."""
    cases = [
        ("abcdef", [(1, 4, "X"), (2, 5, "YY")], "aXf"),  # abYYf, then [1,4) goes
        ("abcdef", [(0, 6, "-"), (2, 3, "long")], "-def"),  # ablongdef, then six code points go
        ("abcdef", [(2, 2, "1"), (2, 2, "2")], "ab21cdef"),  # equal starts in input order
        ("abc", [(1, 9, "Z")], "aZ"),  # an end past the text is cut
        ("abc", [(0, 2, "Q"), (1, 9, "Z")], "Q"),
        ("abc", [(3, 3, "!")], "abc!"),
        ("a😀b", [(1, 2, "")], "ab"),
    ]
    df = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(cases)], f"id int, text string, edits array<{spans.EDIT}>")
    made = {r["id"]: r["r"] for r in df.select("id", spans.splice_text("text", "edits").alias("r")).collect()}
    assert [made[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_order_is_stable(spark):
    items = [(3, 5, "a", "1", 1.0), (1, 9, "b", "2", 1.0), (3, 5, "c", "3", 1.0), (1, 2, "d", "4", 1.0)]
    df = spark.createDataFrame([(items,)], f"items array<{spans.ITEM}>")
    row = df.select(
        spans.order_items("items").alias("up"), spans.order_items("items", True).alias("down")
    ).first()
    assert [x["type"] for x in row["up"]] == ["d", "b", "a", "c"]
    assert [x["type"] for x in row["down"]] == ["a", "c", "b", "d"]


def test_identify_merges_patterns_with_entities(spark):
    from inkveil.operators.recognize import identify

    rng = random.Random(6)
    cases = []
    for i in range(3000):
        text = random_text(rng, 10)
        entities = []
        for _ in range(rng.randrange(5)):
            start = rng.randrange(len(text) + 1)
            end = min(len(text), start + rng.randrange(30))
            entities.append((start, end, "name", text[start:end], rng.choice([0.8, 0.8, 1.0, 0.5])))
        cases.append((i, text, rng.choice([entities, entities, None])))
    df = spark.createDataFrame(cases, f"id int, text string, entities array<{spans.ITEM}>")
    for row in df.select("id", identify("text", "entities").alias("items")).collect():
        _, text, entities = cases[row["id"]]
        assert [tuple(x) for x in row["items"]] == model.merge(model.structured(text) + (entities or [])), text


def test_own_patterns_join_the_registry(spark):
    from inkveil.functions.patterns import PATTERNS, Pattern

    plates = [*PATTERNS, Pattern("plate", r"[京沪][A-Z]\p{Nd}{5}", confidence=0.9)]
    df = spark.createDataFrame([("车牌京A12345，电话13812345678",)], "text string")
    items = df.select(find_structured("text", plates).alias("i")).first()["i"]
    assert [(x["type"], x["value"], x["confidence"]) for x in items] == [("plate", "京A12345", 0.9), ("phone", "13812345678", 1.0)]


def test_gazetteer_prefers_longer_terms_and_survives_many(spark):
    from inkveil.operators.recognize import gazetteer

    terms = [("南京", "address"), ("南京市", "address"), ("市长", "name")] + [(f"t{i}.", "name") for i in range(1200)]
    df = spark.createDataFrame([("南京市长 t1199. t11",)], "text string")
    items = df.select(gazetteer("text", terms).alias("i")).first()["i"]
    assert [(x["start_pos"], x["value"], x["type"]) for x in items] == [(0, "南京市", "address"), (5, "t1199.", "name")]


BOUNDS = [
    {"literal_terms": 3},  # a lexicon of all terms
    {"literal_terms": 3, "lexicon_terms": 6},  # of those that occur
    {"literal_terms": 3, "lexicon_terms": 0, "map_bytes": 1 << 14},  # joined at their places
]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_gazetteer_of_any_size_agrees(spark, monkeypatch, bounds):
    from inkveil.operators import gazetteer as index
    from inkveil.operators import recognize

    terms = [("南京", "address"), ("南京市", "name"), ("南京市", "address"), ("市长", "name"), ("a", "x"), ("ab.", "x"), ("b.c", "y"), ("aa", "z")]
    terms += [("😀b", "x"), ("", "x"), (None, "x"), ("q", None), ("absent", "x"), ("absent too", "x"), ("long " * 50, "w")]
    rng = random.Random(4)
    texts = ["南京市长 ab.c", "", None, "aaaab.c", "q", "aaaab.c", "x" + "long " * 130] + ["".join(rng.choice("ab.c😀南京市长") for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    table = spark.createDataFrame(terms, "term string, type string")
    literal = recognize.gazetteer_items(docs, table)
    wanted = {r.doc_id: r["items"] for r in literal.collect()}
    monkeypatch.setattr(recognize, "vocabulary", None)
    monkeypatch.setattr(index, "GROUP_LETTERS", 16)
    found = recognize.gazetteer_items(docs, table, **bounds)
    assert found.schema["items"].dataType.simpleString() == literal.schema["items"].dataType.simpleString()
    assert {r.doc_id: r["items"] for r in found.collect()} == wanted and found.count() == len(texts)


def test_lexicon_finds_what_plain_search_finds():
    from inkveil.operators import gazetteer as index

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé😀 ") for _ in range(rng.randint(1, 9))) for _ in range(3000)})
    import pyarrow as pa

    lexicon = index.lexicon_of(pa.table({"term": words, "type": [f"t{len(w) % 3}" for w in words]}))
    texts = ["".join(rng.choice("abé😀 c") for _ in range(rng.randint(0, 400))) for _ in range(50)] + [None, ""]
    codes, at = index.laid_out(texts)
    position, length, _ = lexicon.find(codes)
    found = set(zip(position.tolist(), length.tolist()))
    known, wanted = set(words), set()
    for start, text in zip(at.tolist(), texts):
        for i in range(len(text or "")):
            sizes = [n for n in range(1, 10) if i + n <= len(text) and text[i : i + n] in known]
            if sizes:
                wanted.add((start + i, max(sizes)))
    assert found == wanted


def test_chance_hits_of_a_full_map_die_out(monkeypatch):
    """A map with a third of its bits set by other terms lets few positions come to the lengths of terms."""
    import numpy as np

    from inkveil.operators import gazetteer as index

    tried = [0]
    real = index.whole_hashes

    def counted(runs, at, length):
        tried[0] += len(at)
        return real(runs, at, length)

    monkeypatch.setattr(index, "whole_hashes", counted)
    bits = np.random.default_rng(3)
    bitmap = bits.integers(0, 256, 1 << 17, np.uint8) & bits.integers(0, 256, 1 << 17, np.uint8) | bits.integers(0, 256, 1 << 17, np.uint8) & 17
    codes = bits.integers(97, 123, 20_000).astype(np.uint32)
    found = sum(len(at) for _, at, _ in index.Lexicon(bitmap, list(range(10, 50))).may_begin(codes, len(codes)))
    assert tried[0] < 2 * len(codes) and found < len(codes) // 20


@pytest.mark.parametrize("group", [1 << 18, 7])
def test_places_of_pieces(monkeypatch, group):
    """Letters of one to four bytes, pieces at the ends of texts, none across two texts."""
    from inkveil.operators import gazetteer as index
    import pyarrow as pa

    monkeypatch.setattr(index, "GROUP_LETTERS", group)
    monkeypatch.setattr(index, "PIECE_LETTERS", 8)
    terms = ["é😀", "a", "京b京b京", "é", "long term, long"]
    texts = ["é😀aé", "", "京b京b京b京", "é", "😀a long term, long"]
    lexicon = index.lexicon_of(pa.table({"term": terms, "type": ["x"] * len(terms)}))
    found = {(n, p, t) for numbers, starts, pieces in index.candidates(texts, lexicon) for n, p, t in zip(numbers.tolist(), starts.tolist(), pieces.to_pylist())}
    wanted = {(n, p, t) for n, text in enumerate(texts) for t in terms for p in range(len(text)) if text.startswith(t, p)}
    assert wanted <= found and all(texts[n].startswith(t, p) for n, p, t in found)


@pytest.mark.parametrize("wrong_limit", [1000, 0])
def test_spans_are_chosen_among_pieces_that_are_no_terms(spark, monkeypatch, wrong_limit):
    """A map so small that much passes it by chance: nothing wrong is chosen, and nothing right is lost."""
    from inkveil.operators import gazetteer as index

    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(3000)})
    texts = [None, ""] + ["".join(rng.choice("abcd") for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = spark.createDataFrame([(t, f"t{len(t) % 3}") for t in terms], "term string, type string")
    size = (len(terms), sum(map(len, terms)))
    monkeypatch.setattr(index, "SLICE_BITS", 1 << 13)
    given = []
    real = index.by_places
    monkeypatch.setattr(index, "by_places", lambda *a: given.append(a[-1]) or real(*a))
    found = index.find_terms(docs, table, "text", "items", size, lexicon_terms=0, map_bytes=1 << 10, wrong_limit=wrong_limit)
    wanted = index.search(docs, index.lexicon_of(table.toArrow()), "text", "items")
    assert {r.doc_id: r["items"] for r in found.collect()} == {r.doc_id: r["items"] for r in wanted.collect()}
    assert (given[0] is None) == (wrong_limit == 0) and (wrong_limit == 0 or len(given[0]) > 0)


@pytest.mark.parametrize("share, parts", [(1, 1), (1, 5), (0, 5)])
def test_types_are_found_in_place(spark, monkeypatch, share, parts):
    """By a map where few terms pass it with a second type, else by a join; terms are searched for in parts."""
    from inkveil.operators import gazetteer as index

    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("abé😀") for _ in range(rng.randint(1, 9))) for _ in range(2000)})
    texts = [None, "", "zzz"] + ["".join(rng.choice("abé😀z") for _ in range(300)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = spark.createDataFrame([(t, f"t{len(t) % 3}") for t in terms], "term string, type string")
    made = []
    real = index.map_of
    monkeypatch.setattr(index, "map_of", lambda *a, **b: made.append(b.get("parts", 1)) or real(*a, **b))
    monkeypatch.setattr(index, "UNSURE_SHARE", share)
    monkeypatch.setattr(index, "TYPE_BITS_PER_TERM", 8)
    monkeypatch.setattr(index, "SLICE_BITS", 1 << 13)
    monkeypatch.setattr(index, "LEAST_BITS", parts * (1 << 17) // len(terms))
    size = (len(terms), sum(map(len, terms)))
    found = index.find_terms(docs, table, "text", "items", size, lexicon_terms=0, map_bytes=1 << 14, wrong_limit=10**6)
    assert made.count(parts) >= parts
    assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == (share == 0)
    wanted = index.search(docs, index.lexicon_of(table.toArrow()), "text", "items")
    assert {r.doc_id: r["items"] for r in found.collect()} == {r.doc_id: r["items"] for r in wanted.collect()}


def test_copies_of_a_text_are_searched_once_by_a_task(spark):
    from inkveil.operators import gazetteer as index

    docs = spark.range(1000).selectExpr("'one two three' as text").coalesce(1)
    terms = spark.createDataFrame([("two", "x"), ("one", "y")], "term string, type string")
    placed = index.located(docs, F.unhex(F.md5("text")), "text", index.map_of(terms, 2, 1 << 14))
    assert sorted((r["_start"], r["_piece"]) for r in placed.collect()) == [(0, "one"), (4, "two")]
    found = index.find_terms(docs, terms, "text", "items", (2, 6), lexicon_terms=0).groupBy("items").count().collect()
    assert [([(x["start_pos"], x["type"]) for x in r["items"]], r["count"]) for r in found] == [([(0, "y"), (4, "x")], 1000)]


def test_a_lexicon_needs_no_shuffle(spark):
    from inkveil.operators.recognize import gazetteer_items

    docs = spark.range(100).selectExpr("id as doc_id", "concat('a term', id, ' b') as text")
    terms = spark.range(20_000).selectExpr("concat('term', id) as term", "'name' as type")
    found = gazetteer_items(docs, terms)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {x["items"][0]["value"] for x in found.collect()} == {f"term{i}" for i in range(100)}


def test_copies_of_annotations(spark):
    from inkveil.operators.recognize import entity_items

    rng = random.Random(7)
    cases = [(i, x) for i in range(300) for x in random_items(rng, 6) for _ in range(rng.choice([1, 1, 3]))]
    flat = [(i, *x[:3], "v", x[4]) for i, x in cases]
    rng.shuffle(flat)
    fields = "id int, start_pos int, end_pos int, type string, value string, confidence double"
    rows = entity_items(spark.createDataFrame(flat, fields), "id").select(
        "id", "entity_count", spans.merge_items("entities").alias("m")
    )
    for row in rows.collect():
        own = sorted(x[1:] for x in flat if x[0] == row["id"])
        assert row["entity_count"] == len(own)
        assert [tuple(x) for x in row["m"]] == model.merge(own)


def test_many_items_under_one_annotation(spark):
    """Work stays far from the square of a group of overlapping items."""
    from inkveil.operators.recognize import identify

    n = 50_000
    entity = "array(named_struct('start_pos', 0, 'end_pos', 0 + length(text), 'type', 'address', 'value', text, 'confidence', 0.8D))"
    df = spark.range(1).select(F.repeat(F.lit("13812345678,"), n).alias("text")).withColumn("entities", F.expr(entity))
    items = df.select(identify("text", "entities").alias("i")).select(F.size("i").alias("n"), F.expr("i[0].type").alias("t")).first()
    assert (items["n"], items["t"]) == (n, "phone")
