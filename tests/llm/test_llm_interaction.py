import random
import re
from collections import Counter
from itertools import permutations

from inkveil.llm import interaction as I

SCHEMA = "doc_id long, text string, source string"


def masks(docs):
    out = []
    for doc_id, text, source in docs:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = ""
        fails += "A" if len(words) < 50 else ""
        fails += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else ""
        fails += "D" if re.search("[#$%&*|]", t) else ""
        fails += "E" if doc_id is not None and any((u or "") == t and i is not None and i < doc_id for i, u, _ in docs) else ""
        out.append((source or "", fails, doc_id))
    return out


def plain(docs, labels):
    rows = masks(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {r[0] for r in rows}:
        own = [(f, i) for p, f, i in rows if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, name in enumerate(order, 1):
                gone = [(f, i) for f, i in left if name in f]
                left = [(f, i) for f, i in left if name not in f]
                failing = sum(name in f for f, _ in own)
                shapley[name] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), failing - len(gone), sum(f == name for f, _ in own),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), name,
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(*d, 5, "x", 1) for d in docs], f"{SCHEMA}, mask int, part string, n int").repartition(3)
    made = I.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = made.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_all_orders(spark):
    draw = random.Random(2)
    words = ["ab", "Cd", "EF", "g#", "h|i", "é", "x y", "😀", "LOUD"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choice(words[: draw.choice([9, 69])]) for _ in range(draw.randint(0, 120))) for _ in range(40)]
    texts += [None, "", "\t\n", " ", " ".join(words[9:]), "word " * 20_000]
    docs = [(i if i % 9 else None, draw.choice(texts), draw.choice(["a", "a", "b", None, ""])) for i in range(300)]
    docs += [docs[5], docs[5], (5, texts[0], "c"), (5, texts[0], "c"), (None, texts[0], "c"), (-1, None, "d")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 300, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_many_copies_of_one_text(spark):
    docs = [(i, "same text", "hot") for i in range(2000)] + [(i, f"text {i}", "b") for i in range(2000, 2100)]
    assert audited(spark, docs, [(0, 1, 1), (7, 1, 1)]) == plain(docs, [(0, 1, 1), (7, 1, 1)])


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        spans = sorted((low, high) for m, _, low, high in I.intervals(I.FILTERS) if m == mask)
        assert spans[0][0] == 0 and spans[-1][1] == 120 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty(spark):
    assert audited(spark, [], []) == {}
