import hashlib
import random
import re

import pytest

import corpus_pipeline
from inkveil.llm.queries import ORACLES, QUERIES
from test_llm_simhash import plain_components, plain_fingerprint
from test_llm_tokens import LIBRARY

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ne", "sa", "do", "vi", "pa", "x")]
    items = [" ".join(f"{draw.choice(words)}q{i}" for _ in range(20)) for i in range(4)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(5, 300))) for _ in range(60)]
    texts += [texts[3], texts[4] + " ", texts[5].replace(" ", "\n"), texts[6].upper(), None, "", " 1 2", "!", f"{texts[7]} {items[1]}", items[2], items[2]]
    rows = [(i, t, "xx", "s", 0) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, texts[9], "xx", "s", 0), (None, "only here", None, None, None)], items


def plain(rows, items):
    kept = [r[:2] for r in rows if r[1] is not None and re.search(r"[^\W\d_]", r[1])]
    groups = {}
    for row in kept:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", row[1]), []).append(row)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    marks = [(n, plain_fingerprint(t)) for n, (_, t) in enumerate(kept)]
    kept = [kept[n] for n in sorted(set(plain_components(marks, 2)))]
    kept = [r for r in kept if not any(item in r[1] for item in items)]
    out = []
    for doc_id, text in kept:
        ids = LIBRARY.encode_ordinary(text)
        digest = [hashlib.sha256(b).hexdigest() for b in (",".join(map(str, ids)).encode(), text.encode())]
        out.append((doc_id, len(ids), *digest))
    return out


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, plain(rows, items))) == sorted(repr(tuple(r)) for r in made)


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, items = corpus()
    clashing = ["score", "row_hash", "_gone", "__gone", "row", "given", "fp", "id", "digest", "lang_pred", "_language", "key", "bytes"]
    extra = "".join(f", {name} string" for name in clashing)
    docs = spark.createDataFrame([(*r, *clashing) for r in rows], COLUMNS + extra)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_against_sql(spark, key):
    import duckdb

    from verify import rows_of

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        duck.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    cursor = duck.execute(ORACLES[key])
    made = QUERIES[key](spark, sf)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    assert rows_of(made.columns, made.collect()) == rows_of(columns, cursor.fetchall())
