"""Rewriting of documents by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import sql as X
from inkveil.functions.masking import rewrite_value
from inkveil.functions.spans import splice_text
from inkveil.functions.sql import Expr, expression
from inkveil.operators.joins import lookup_join
from inkveil.operators.rules import first_enabled_rule

#: Column that carries the rules while documents are rewritten.
_RULES = "_rules_by_type"


def _edits(items: Expr, strategy_of) -> Expr:
    """Edits of an item array; items without a rule or with an unknown strategy give none."""
    new = X.transform(
        items,
        lambda x: X.struct(
            x["start_pos"].alias("start_pos"),
            x["end_pos"].alias("end_pos"),
            rewrite_value(x["value"], x["type"], strategy_of(x["type"])).alias("new_value"),
        ),
    )
    return X.filter(new, lambda x: x["new_value"].isNotNull())


def rules_by_type(rules: DataFrame) -> Column:
    """Data type -> (id, strategy) of its first enabled rule, as a scalar subquery: one entry per type."""
    entry = F.struct("data_type", F.struct("id", "strategy"))
    first = first_enabled_rule(rules).where("data_type is not null")
    return first.agg(F.map_from_entries(F.collect_list(entry)).alias("rules")).scalar()


@expression
def deidentify_text(text: Expr, items: Expr, rules: Expr) -> Expr:
    """``text`` with its items rewritten, given the map of ``rules_by_type``."""
    return splice_text(text, _edits(items, lambda type_: X.try_element_at(rules, type_)["strategy"]))


def deidentify(docs: DataFrame, rules: DataFrame, text: str = "text", items: str = "items", out: str = "deid_text") -> DataFrame:
    """Documents with their text rewritten by the first enabled rule of each item's type.

    Each item looks its rule up in its own row, however many types there are; documents are
    neither joined nor shuffled.
    """
    ruled = docs.withColumn(_RULES, rules_by_type(rules))
    return ruled.withColumn(out, deidentify_text(text, items, _RULES)).drop(_RULES)


def preview_statistics(items: DataFrame, rules: DataFrame, key: str = "task_id") -> DataFrame:
    """Per document: its items, those whose type has an enabled rule, and the ids of these rules.

    Whether the strategy of the rule exists does not matter here. The lookup happens where
    the items are; counts, and at most one rule per type, are shuffled.
    """
    ruled = first_enabled_rule(rules).select(F.col("data_type").alias("type"), F.col("id").alias("rule"))
    matched = lookup_join(items.select(key, "type"), ruled, "type", "left")
    return matched.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count("rule").alias("desensitized_items"),
        F.array_sort(F.collect_set("rule")).alias("applied_rules"),
    )


def preview(
    docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", items: str = "items"
) -> DataFrame:
    """Original and rewritten text side by side, with the item counts and the ids of the rules applied."""
    ruled = docs.withColumn(_RULES, rules_by_type(rules))
    known = X.transform(X.col(items), lambda x: X.try_element_at(X.col(_RULES), x["type"])["id"])
    ids = F.filter(known.column, lambda id_: id_.isNotNull())
    return ruled.withColumn("desensitized", deidentify_text(text, items, _RULES)).select(
        key,
        F.col(text).alias("original"),
        "desensitized",
        F.size(items).cast("bigint").alias("total_items"),
        F.size(ids).cast("bigint").alias("desensitized_items"),
        F.array_sort(F.array_distinct(ids)).alias("applied_rules"),
    )


def value_mapping(items: DataFrame, rules: DataFrame, key: str = "task_id") -> DataFrame:
    """Distinct (document, type, value) -> new value.

    Strategies depend on value and type only, so duplicates go before anything is computed.
    """
    distinct = items.select(key, "type", "value").distinct()
    first = first_enabled_rule(rules).select(F.col("data_type").alias("type"), "strategy")
    known = lookup_join(distinct, first, "type", "inner")
    new = rewrite_value("value", "type", "strategy")
    return known.select(key, "type", "value", new.alias("new_value")).where("new_value is not null")


def items_subset(items: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Items with one of the given ids (column ``id``); no ids means all items."""
    if ids is None:
        return items
    none = ids.agg(F.count(F.lit(1)) == 0).scalar()
    named = ids.select("id", F.lit(True).alias("_named")).distinct()
    joined = lookup_join(items, named, "id", "left").where(F.col("_named") | none)
    return joined.select(items.columns)


def desensitized_items(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items having any enabled rule of their type."""
    types = first_enabled_rule(rules).select(F.col("data_type").alias("type"))
    return lookup_join(items, types, "type", "left_semi")
