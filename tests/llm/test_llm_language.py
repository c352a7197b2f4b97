import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkveil.llm import language
from inkveil.llm.queries import QUERIES
from test_llm_simhash import inner_joins

TEXTS = {"xx": ["abab cdab abba dada", "baba dab"], "yy": ["zyzzy xyz yxz", "zé zxy"], "zz": ["aazz bbyy"]}


def plain_bits(texts, order, data):
    """Code length of ``data`` after counting ``texts``, byte by byte."""
    follow = defaultdict(Counter)
    for text in texts:
        raw = text.encode()
        for i, byte in enumerate(raw):
            for k in range(min(order, i) + 1):
                follow[raw[i - k : i]][byte] += 1
    bits = 0.0
    for i, byte in enumerate(data):
        for k in range(min(order, i), -1, -1):
            seen = follow.get(data[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if byte in seen:
                bits -= math.log2(seen[byte] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


def labelled(spark):
    rows = [(i, t, lang) for lang, texts in TEXTS.items() for i, t in enumerate(texts)]
    rows += [(90, None, "xx"), (91, "", "yy"), (92, "no label", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths(spark, monkeypatch, order):
    monkeypatch.setattr(language, "PIECE", 7)
    model = language.learn(labelled(spark), order=order)
    assert model.languages == ("xx", "yy", "zz")
    draw = random.Random(order)
    for text in ["", "a", "abab", "zyé zx", "qqq", "".join(draw.choice("abdxyz é") for _ in range(60))]:
        made = language.code_lengths(model, np.frombuffer(text.encode(), np.uint8))
        wanted = [plain_bits(TEXTS[lang], order, text.encode()) for lang in model.languages]
        assert made == pytest.approx(wanted, rel=1e-5, abs=1e-4)


def test_predict(spark):
    model = language.learn(labelled(spark))
    rows = [(1, "abab dab"), (2, "zyzzy xy"), (3, None), (4, ""), (5, " 12 !?"), (None, "baba"), (1, "abab dab"), (6, "zyx " * 100_000)]
    docs = spark.createDataFrame([(i, t, 0.5, "q") for i, t in rows], "doc_id long, text string, score double, lang string")
    made = language.predict(docs, model).collect()
    wanted = {1: "xx", 2: "yy", 3: "und", 4: "und", 5: "und", None: "xx", 6: "yy"}
    assert sorted(repr((r.doc_id, r.lang_pred)) for r in made) == sorted(repr((i, wanted[i])) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.lang == "q" for r in made)


def test_nothing_to_learn_from(spark):
    model = language.learn(labelled(spark).limit(0))
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.predict(docs, model).collect()] == [("und", 0.0)]
    assert language.predict(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    made = QUERIES["op9_language_id"](spark, sf).where("held_out")
    truth = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as id", "lang")
    right = made.join(truth, made.doc_id == truth.id).selectExpr("avg(int(lang_pred = lang))").first()[0]
    assert right >= 0.99


def test_every_language_is_drawn_to_its_bound(spark):
    rows = [("xx", f"{i:04d}" + "ab" * 23) for i in range(300)] + [("xx", "copy" * 25)] * 3000
    rows += [("near", letter * 1999) for letter in "pqr"] + [("long", "é" * 5000), ("few", "fff"), ("few", "fff")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    drawn = defaultdict(list)
    for r in language.drawn(docs, 2000).collect():
        drawn[r.lang].append(bytes(r.text))
    assert {lang: sum(map(len, texts)) for lang, texts in drawn.items()} == {"xx": 2000, "near": 2000, "long": 2000, "few": 3}
    assert all(len(texts) == len(set(texts)) for texts in drawn.values())
    model = language.learn(docs, sample_bytes=2000)
    assert model.languages == ("few", "long", "near", "xx")
    made = language.predict(spark.createDataFrame([("éé",), ("abab",)], "text string"), model).collect()
    assert [r.lang_pred for r in made] == ["long", "xx"]


def test_keys_of_texts_are_never_broadcast(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "stored", lambda df, name, f=language.stored: (seen.update({name: inner_joins(df)}), f(df, name))[1])
    language.drawn(spark.createDataFrame([("xx", "some text"), ("yy", "other text")], "lang string, text string"), 2000)
    assert seen["language-sample"] == ["SortMergeJoin"]
