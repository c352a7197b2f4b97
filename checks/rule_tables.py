"""Rule tables: selection, seeding, defaults."""

from pyspark.sql import functions as F

from checks import duck
from checks.fixtures import fx
from checks.registry import check
from inkveil.operators import rules

_SEEDS = """seeds(name, data_type) as (values ('姓名脱敏（掩码）', 'name'), ('身份证脱敏（掩码）', 'id_card'),
    ('手机号脱敏（掩码）', 'phone'), ('地址脱敏（掩码）', 'address'), ('银行卡脱敏（掩码）', 'bank_card'), ('邮箱脱敏（掩码）', 'email'))"""
_FALLBACK = """fallback(id, name, data_type) as (values ('rule_name', '姓名脱敏', 'name'), ('rule_phone', '手机号脱敏', 'phone'),
    ('rule_id_card', '身份证脱敏', 'id_card'), ('rule_address', '地址脱敏', 'address'), ('rule_bank_card', '银行卡脱敏', 'bank_card'),
    ('rule_email', '邮箱脱敏', 'email'))"""


def _rules(spark, sf_dir):
    return fx(spark, sf_dir, "rules")


@check("scan_rules", "rules", "select id, name, data_type, strategy from rules")
def scan_rules(spark, sf_dir):
    return _rules(spark, sf_dir).select("id", "name", "data_type", "strategy")


@check("enabled_rules", "rules", "select id, data_type from rules where enabled")
def enabled_rules(spark, sf_dir):
    return rules.enabled_rules(_rules(spark, sf_dir)).select("id", "data_type")


@check("system_rules", "rules", "select id, data_type from rules where is_system")
def system_rules(spark, sf_dir):
    return rules.system_rules(_rules(spark, sf_dir)).select("id", "data_type")


@check("existing_types", "rules", "select distinct data_type from rules where is_system")
def existing_types(spark, sf_dir):
    return rules.existing_types(_rules(spark, sf_dir))


@check("rules_by_id", "rules", "select id, name from rules where id in ('r1', 'r3', 'r5', 'none')")
def rules_by_id(spark, sf_dir):
    return rules.rules_by_id(_rules(spark, sf_dir), ["r1", "r3", "r5", "none"]).select("id", "name")


@check("rules_by_type_csv", "rules", "select id, data_type from rules where data_type in ('phone', ' email', 'address', 'what')")
def rules_by_type_csv(spark, sf_dir):
    return rules.rules_by_type_csv(_rules(spark, sf_dir), "phone, email,address,what").select("id", "data_type")


@check("first_enabled_rule", "rules", f", {duck.FIRST_RULE} select data_type, id, name, strategy from first_rule")
def first_enabled_rule(spark, sf_dir):
    return rules.first_enabled_rule(_rules(spark, sf_dir))


@check(
    "applied_rules",
    "rules",
    "select string_agg(id, ',' order by id) as applied_rules from (select distinct id from rules where enabled)",
)
def applied_rules(spark, sf_dir):
    run = rules.applied_rules(rules.enabled_rules(_rules(spark, sf_dir)))
    return run.select(F.array_join("applied_rules", ",").alias("applied_rules"))


@check(
    "missing_rules_anti",
    "rules",
    f", {_SEEDS} select name, data_type from seeds where data_type not in (select data_type from rules where is_system)",
)
def missing_rules_anti(spark, sf_dir):
    return rules.missing_rules(_rules(spark, sf_dir), rules.seed_defaults(spark)).select("name", "data_type")


_SEEDED = f"""{_SEEDS}, seeded as (select id, name, data_type, strategy, is_system, enabled from rules
    union all select 'seed-' || data_type, name, data_type, 'mask', true, true from seeds
        where data_type not in (select data_type from rules where is_system))"""


@check("seed_rules", "rules", f", {_SEEDED} select * from seeded")
def seed_rules(spark, sf_dir):
    """Seeded twice, since the second run must add nothing."""
    defaults = rules.seed_defaults(spark)
    once = rules.seed_rules(_rules(spark, sf_dir), defaults)
    return rules.seed_rules(once, defaults).select("id", "name", "data_type", "strategy", "is_system", "enabled")


@check("union_seed", "rules", f", {_SEEDED} select data_type, count(*) as n from seeded group by data_type")
def union_seed(spark, sf_dir):
    seeded = rules.seed_rules(_rules(spark, sf_dir), rules.seed_defaults(spark))
    return seeded.groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "rules_or_default",
    "rules",
    f""", {_FALLBACK} select 'stored' as store, id, name, data_type, strategy, enabled from rules where enabled
    union all select 'disabled', id, name, data_type, 'mask', true from fallback""",
)
def rules_or_default(spark, sf_dir):
    """A store with enabled rules, and the same one with all of them switched off."""
    stored, defaults = _rules(spark, sf_dir), rules.fallback_rules(spark)
    off = stored.withColumn("enabled", F.lit(False))
    parts = [
        rules.rules_or_default(df, defaults).select(F.lit(name).alias("store"), "*")
        for name, df in (("stored", stored), ("disabled", off))
    ]
    return parts[0].unionByName(parts[1])


@check("project_rule", "rules", "select id, name, data_type, strategy, is_system, enabled from rules")
def project_rule(spark, sf_dir):
    from inkveil.operators import tasks

    return tasks.project_rule(_rules(spark, sf_dir))
