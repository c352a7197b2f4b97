"""The plans that matter at scale: what is read, what is shuffled, what is computed twice."""

import re

import pytest

from checks.fixtures import given
from inkveil.operators import assemble, layout, recognize, rewrite
from tests.test_joins import rule_table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def rewritten(spark):
    docs = given(spark, SF, "documents").select("doc_id", "text", recognize.identify("text").alias("items"))
    return rewrite.deidentify(docs, rule_table(spark)).select("doc_id", "deid_text")


def test_rewriting_is_narrow(rewritten):
    text, _, rules = plan(rewritten).partition("Subquery")  # of the documents; the rules are a subquery
    assert "data_type" in rules
    assert "Exchange" not in text and "Join" not in text
    assert "Python" not in text and "ArrowEval" not in text


def test_only_needed_columns_are_read(rewritten):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(rewritten))


def test_each_pattern_is_searched_once_per_text(spark):
    docs = given(spark, SF, "documents").select("doc_id", recognize.identify("text").alias("items"))
    exploded = recognize.explode_items(docs)
    text = exploded._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 4


def test_annotations_join_moves_items_not_texts(spark):
    docs = given(spark, SF, "documents")
    annotations = docs.selectExpr("doc_id", "'PERSON' as label", "0 as start_pos", "1 as end_pos", "left(text, 1) as value")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = recognize.identify_with_annotations(docs, annotations)
        df = found.select("doc_id", "items")
        for line in plan(df).split("\n"):
            if "Exchange hashpartitioning" in line:
                assert "text#" not in line
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layout_is_narrow(spark):
    docs = given(spark, SF, "documents").selectExpr("doc_id", "text as content")
    for df in (
        layout.export_cells(docs),
        layout.export_blocks(docs),
        layout.sheet_of_line(docs),
        layout.md_table_head(docs),
        docs.select("doc_id", layout.export_markdown("content").alias("md")),
    ):
        assert "Exchange" not in plan(df)


def test_assembly_spreads_a_document_over_blocks(spark):
    # One document with many pages: no first-level group holds more than one block of them.
    pages = spark.range(10_000).selectExpr("id div 100000 as doc_id", "id as page_no", "concat('p', id) as text")
    row = assemble.assemble_pages(pages).first()
    assert row["content"] == "\n".join(f"p{i}" for i in range(10_000)) and row["page_count"] == 10_000
    text = plan(assemble.assemble_pages(pages))
    assert re.search(r"hashpartitioning\(doc_id#\d+L, _(block|groupingexpression)#", text)


def test_statistics_are_combined_before_the_shuffle(spark):
    items = given(spark, SF, "lineitem").selectExpr("l_orderkey as task_id", "l_returnflag as type")
    text = plan(rewrite.preview_statistics(items, rule_table(spark)))
    assert "partial_count" in text
