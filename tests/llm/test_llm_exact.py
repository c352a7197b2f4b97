import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkveil.llm import exact
from test_llm_simhash import inner_joins

ROWS = [
    (3, "a  b"), (1, "a\tb"), (2, "a b "), (4, None), (5, ""), (6, " "), (7, "\n\n"), (None, "a b"), (8, "é b"),
    (9, "x" * 100_000), (10, "x" * 100_000), (11, "same"), (11, "same"), (11, "same"), (12, "a b"), (None, "lone"),
]


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for members in groups.values():
        first = min(members, key=lambda i: (i is None, i or 0))
        kept = members.index(first)
        out += [(i, first, len(members), n == kept) for n, i in enumerate(members)]
    return out


def summary(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("weak", [False, True])
def test_groups(spark, weak):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in ROWS], "doc_id long, text string, digest string, kept int").repartition(3)
    digest = (lambda t: F.substring(t, 1, 1)) if weak else exact.sha256
    made = exact.exact_duplicates(docs, digest=digest, files_per_batch=1).collect()
    assert summary(plain(ROWS)) == summary((r.doc_id, r.keep_id, r.group_size, r.kept) for r in made)


def test_digests_of_documents_are_never_broadcast(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(exact, "stored", lambda df, name, f=exact.stored: (seen.update({name: inner_joins(df)}), f(df, name))[1])
    made = exact.exact_duplicates(spark.createDataFrame([(i, f"text {i // 2}") for i in range(8)], "doc_id long, text string"))
    assert seen["exact-hits"] == inner_joins(made) == ["SortMergeJoin"]


def test_state_goes_on(spark, tmp_path):
    """A second run with the same checkpoint sees only what is new and keeps what it knew."""
    schema = "digest string, id long, locator struct<content: long, row: long>"
    folder, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for part, rows in enumerate([[("a", 5, (1, 1)), ("b", 6, (2, 2))], [("a", 3, (3, 3)), ("c", 7, (4, 4))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={part}")
        arrivals = spark.readStream.schema(schema).parquet(f"{folder}/*")
        exact.keep_state(arrivals, log, state)
    latest = spark.read.parquet(log).groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s"))
    assert {(r.digest, r.s.first.id, r.s.n) for r in latest.collect()} == {("a", 3, 2), ("b", 6, 1), ("c", 7, 1)}


def test_empty(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
