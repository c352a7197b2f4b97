"""Rule tables: seeding, selection and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.constants import FALLBACK_RULES, SEED_RULES
from inkveil.operators.joins import lookup_join


def seed_defaults(spark: SparkSession) -> DataFrame:
    """The six system rules (name, data_type, strategy, is_system, enabled)."""
    return spark.createDataFrame(
        [(name, kind, "mask", True, True) for name, kind in SEED_RULES],
        "name string, data_type string, strategy string, is_system boolean, enabled boolean",
    )


def fallback_rules(spark: SparkSession) -> DataFrame:
    """The six rules of a run without stored rules (id, name, data_type, strategy, enabled)."""
    return spark.createDataFrame(
        [(id_, name, kind, "mask", True) for id_, name, kind in FALLBACK_RULES],
        "id string, name string, data_type string, strategy string, enabled boolean",
    )


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.where("enabled")


def system_rules(rules: DataFrame) -> DataFrame:
    return rules.where("is_system")


def existing_types(rules: DataFrame) -> DataFrame:
    """Data types that have a system rule."""
    return system_rules(rules).select("data_type").distinct()


def missing_rules(rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """Defaults whose data type has no system rule yet.

    The stored side is cut down to the six types of the defaults before it is compared, so
    at most six rows are broadcast.
    """
    wanted = F.broadcast(defaults.select("data_type").distinct())
    present = existing_types(rules.join(wanted, "data_type", "left_semi"))
    return defaults.join(F.broadcast(present), "data_type", "left_anti")


def seed_rules(rules: DataFrame, defaults: DataFrame, id_prefix: str = "seed-") -> DataFrame:
    """Stored rules plus the missing defaults; running it again adds nothing.

    New ids are derived from the data type, so a retried run writes the same rows.
    """
    new = missing_rules(rules, defaults).withColumn("id", F.concat(F.lit(id_prefix), "data_type"))
    return rules.unionByName(new, allowMissingColumns=True)


def rules_by_id(rules: DataFrame, ids: list[str]) -> DataFrame:
    """Rules with one of the given ids; no ids, no rules."""
    return rules.where(F.col("id").isin(ids))


def rules_by_type_csv(rules: DataFrame, csv: str) -> DataFrame:
    """Rules of the types in a comma-separated list, taken literally (no trimming)."""
    return rules.where(F.col("data_type").isin(csv.split(",")))


def rules_or_default(rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """Enabled stored rules, or all defaults when there is none."""
    stored = enabled_rules(rules)
    return stored.select(*defaults.columns).unionByName(defaults.where(~stored.exists()))


def first_enabled_rule(rules: DataFrame) -> DataFrame:
    """The rule applied to each data type: the first enabled one by (created_at, id).

    A minimum is combined before the shuffle, which a ranking window is not.
    """
    first = F.min(F.struct("created_at", "id", "name", "strategy")).alias("first")
    return (
        enabled_rules(rules)
        .groupBy("data_type")
        .agg(first)
        .select("data_type", F.col("first.id").alias("id"), F.col("first.name").alias("name"), F.col("first.strategy").alias("strategy"))
    )


def item_rule_lookup(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items (keyed by ``id``) with rule_id and strategy of their rule, null without one."""
    first = first_enabled_rule(rules).select(
        F.col("data_type").alias("type"), F.col("id").alias("rule_id"), "strategy"
    )
    return lookup_join(items, first, "type", "left")


def applied_rules(rules: DataFrame) -> DataFrame:
    """One row with the sorted ids of the rules of a run."""
    return rules.agg(F.sort_array(F.collect_set("id")).alias("applied_rules"))
