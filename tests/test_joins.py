"""The ways joins take when a side is not small, against plain joins."""

import pytest
from pyspark.sql import functions as F

from inkveil.operators import joins, rewrite, rules, tasks


@pytest.fixture()
def sides(spark):
    # One key holds a third of the rows, one is null, some have no partner.
    big = spark.range(30_000).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 1000 = 1 then null else concat('k', id % 500) end as key"
    )
    small = spark.range(400).selectExpr("concat('k', id) as key", "id as v").unionByName(
        spark.sql("select 'hot' as key, bigint(-1) as v union all select 'hot', bigint(-2)")
    )
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(sides, how):
    big, small = sides
    plain = big.join(small, "key", how)
    spread = joins.skew_join(big, small, "key", how, F.col("id")).select(plain.columns)
    assert spread.count() == plain.count()
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()


def test_only_hot_keys_are_split(sides):
    big, _ = sides
    assert [r["key"] for r in joins.hot_keys(big, "key").collect() if r["key"] == "hot"] == ["hot"]
    assert joins.hot_keys(big, "key").count() <= 1 / joins.HOT_SHARE


def test_no_job_runs_while_a_plan_is_built(spark, sides):
    big, small = sides
    group = "plans-only"
    spark.sparkContext.setJobGroup(group, group)
    try:
        joins.lookup_join(big, small, "key", "left")
        rewrite.deidentify(identified(spark), rule_table(spark))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_task_joins_agree_whatever_the_size(spark):
    items = spark.range(2000).selectExpr("cast(id as string) as id", "cast(if(id % 2 = 0, 7, id % 90) as string) as task_id")
    alive = spark.range(50).selectExpr("cast(id as string) as id", "'f' as filename", "'parsed' as status")
    logs = items.selectExpr("id", "task_id", "'upload' as operation_type")
    new = items.where("task_id = '7'").limit(3).withColumn("id", F.concat(F.lit("n"), "id"))

    def counts():
        return (
            tasks.items_cascade(items, alive).count(),
            tasks.task_items_join(alive, items).count(),
            tasks.logs_set_null(logs, alive).where("task_id is null").count(),
            tasks.refresh_items(items, new).count(),
        )

    small = counts()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert counts() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


RULES = [
    ("1", "a", "phone", "mask", True, "2024-01-02"),
    ("2", "b", "phone", "delete", True, "2024-01-03"),
    ("3", "c", "phone", "replace", False, "2024-01-01"),
    ("4", "d", "email", "replace", True, "2024-01-01"),
    ("5", "e", "bank_card", "unheard_of", True, "2024-01-01"),
]


def rule_table(spark, rows=RULES):
    names = "id string, name string, data_type string, strategy string, enabled boolean, day string"
    return spark.createDataFrame(rows, names).withColumn("created_at", F.to_timestamp("day")).drop("day")


def identified(spark):
    from inkveil.operators.recognize import identify

    texts = [
        (1, "打电话13812345678或a@b.com，卡6222021234567890"),
        (2, "nothing here"),
        (3, ""),
        (4, None),
        (5, "13812345678,13812345678"),
    ]
    return spark.createDataFrame(texts, "doc_id int, text string").withColumn("items", identify("text"))


EXPECTED = {
    1: "打电话138****5678或[邮箱]，卡6222021234567890",
    2: "nothing here",
    3: "",
    4: None,
    5: "138****5678,138****5678",
}


def test_rewriting(spark):
    docs, table = identified(spark), rule_table(spark)
    assert {r["doc_id"]: r["deid_text"] for r in rewrite.deidentify(docs, table).collect()} == EXPECTED
    stats = {r["doc_id"]: r for r in rewrite.preview(docs, table).collect()}
    assert [(stats[i]["total_items"], stats[i]["desensitized_items"]) for i in (1, 2, 5)] == [(3, 3), (0, 0), (2, 2)]
    assert [stats[i]["applied_rules"] for i in (1, 2, 5)] == [["1", "4", "5"], [], ["1"]]


def test_many_types_repeated_and_null_keys(spark):
    """Documents that share a key, or have none, keep to themselves however many types have rules."""
    many = [(f"m{i}", "n", f"type{i}", "delete", True, "2024-01-01") for i in range(1000)]
    texts = [(7, "a 13812345678"), (7, "bb 13912345678 z"), (None, "n 13712345678")]
    docs = identified(spark).limit(0).select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id int, text string"))
    from inkveil.operators.recognize import identify

    found = docs.withColumn("items", identify("text"))
    for rows in (RULES, RULES + many):
        made = [r["deid_text"] for r in rewrite.deidentify(found, rule_table(spark, rows)).collect()]
        assert sorted(made) == ["a 138****5678", "bb 139****5678 z", "n 137****5678"]


def test_disabled_rules_change_nothing(spark):
    off = rule_table(spark).withColumn("enabled", F.lit(False))
    rows = rewrite.deidentify(identified(spark), off).collect()
    assert all(r["deid_text"] == r["text"] for r in rows)


def test_first_enabled_rule_goes_by_time_then_id(spark):
    first = {r["data_type"]: r["id"] for r in rules.first_enabled_rule(rule_table(spark)).collect()}
    assert first == {"phone": "1", "email": "4", "bank_card": "5"}


def test_seeding_is_idempotent_and_keeps_own_rules(spark):
    own = rule_table(spark).withColumn("is_system", F.lit(False))
    defaults = rules.seed_defaults(spark)
    once = rules.seed_rules(own, defaults)
    twice = rules.seed_rules(once, defaults)
    assert once.count() == twice.count() == len(RULES) + 6


def test_a_registered_strategy_is_used(spark):
    from inkveil.functions import masking

    masking.register_strategy("unheard_of", lambda value, type_: value[:0] if isinstance(value, str) else masking.F.concat("#", type_))
    try:
        rows = rewrite.deidentify(identified(spark), rule_table(spark)).collect()
        assert {r["doc_id"]: r["deid_text"] for r in rows}[1].endswith("卡#bank_card")
    finally:
        del masking.STRATEGIES["unheard_of"]
