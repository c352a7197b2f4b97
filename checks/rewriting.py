"""Rewriting: masks, strategies, rules applied to items and texts."""

from pyspark.sql import functions as F

from checks import duck
from checks.fixtures import fx
from checks.registry import check
from inkveil.functions import masking, spans
from inkveil.functions import sql as X
from inkveil.operators import recognize, rewrite, rules

_VALUES = f"""values_in as (select task_id, type, value as v from items
    union all select cast(doc_id as varchar), type, value from entity_items
    union all select cast(doc_id as varchar), type, value from structured)"""
_VALUES_CTES = f", {duck.structured('corpus')}, {duck.ENTITY_ITEMS}, {_VALUES}"
_VALUES_NEED = "items corpus entities"


def _values(spark, sf_dir):
    """All item values: table items of every shape, and the entities and matches of the texts."""
    stored = fx(spark, sf_dir, "items").select("task_id", "type", F.col("value").alias("v"))
    entities = recognize.entity_label_map(fx(spark, sf_dir, "entities")).select(
        F.col("doc_id").cast("string").alias("task_id"), "type", F.col("value").alias("v")
    )
    found = recognize.explode_items(fx(spark, sf_dir, "corpus").select("doc_id", recognize.identify("text").alias("items")))
    return stored.unionAll(entities).unionAll(
        found.select(F.col("doc_id").cast("string").alias("task_id"), "type", F.col("value").alias("v"))
    )


def _mask_check(kind, mask):
    # Every mask sees every value, so that its edge cases are met whatever the type.
    @check(f"mask_{kind}", _VALUES_NEED, f"{_VALUES_CTES} select distinct v, {duck.MASK[kind]} as masked from values_in where v <> ''")
    def query(spark, sf_dir):
        values = _values(spark, sf_dir).where("v <> ''").select("v").distinct()
        return values.select("v", mask("v").alias("masked"))


for _kind, _mask in [*masking.MASKS.items(), ("default", masking.mask_default)]:
    _mask_check(_kind, _mask)


def _strategy_check(key, strategy, sql):
    @check(key, _VALUES_NEED, f"{_VALUES_CTES} select distinct type, v, {sql} as new_value from values_in")
    def query(spark, sf_dir):
        values = _values(spark, sf_dir).select("type", "v").distinct()
        return values.select("type", "v", strategy("v", "type").alias("new_value"))


_strategy_check("mask_value", masking.mask_value, duck.mask("v", "type"))
_strategy_check("replace_value", masking.replace_value, duck.PLACEHOLDER.format(t="type"))
_strategy_check("delete_value", masking.delete_value, "''")


@check(
    "rule_strategy_lookup",
    _VALUES_NEED + " rules",
    f"""{_VALUES_CTES}, {duck.FIRST_RULE}
    select distinct type, v, strategy, coalesce({duck.rewrite('v', 'type', 'strategy')}, v) as new_value
    from values_in join first_rule on data_type = type""",
)
def rule_strategy_lookup(spark, sf_dir):
    """Value under the strategy its rule names; unknown names leave it as it is."""
    first = rules.first_enabled_rule(fx(spark, sf_dir, "rules")).select(F.col("data_type").alias("type"), "strategy")
    values = _values(spark, sf_dir).select("type", "v").distinct()
    known = rewrite.lookup_join(values, first, "type", "inner")
    return known.select(
        "type", "v", "strategy", F.coalesce(masking.rewrite_value("v", "type", "strategy"), "v").alias("new_value")
    )


@check(
    "item_rule_lookup",
    "items rules",
    f""", {duck.FIRST_RULE} select items.id, items.type, first_rule.id as rule_id, strategy
    from items left join first_rule on data_type = type""",
)
def item_rule_lookup(spark, sf_dir):
    return rules.item_rule_lookup(fx(spark, sf_dir, "items").select("id", "type"), fx(spark, sf_dir, "rules"))


@check(
    "desensitized_item_semi",
    "items rules",
    "select id, type from items where type in (select data_type from rules where enabled)",
)
def desensitized_item_semi(spark, sf_dir):
    return rewrite.desensitized_items(fx(spark, sf_dir, "items"), fx(spark, sf_dir, "rules")).select("id", "type")


@check(
    "value_mapping",
    "items rules",
    f""", {duck.FIRST_RULE} select * from (
        select distinct task_id, type, value, {duck.rewrite('value', 'type', 'strategy')} as new_value
        from items join first_rule on data_type = type) where new_value is not null""",
)
def value_mapping(spark, sf_dir):
    return rewrite.value_mapping(fx(spark, sf_dir, "items"), fx(spark, sf_dir, "rules"))


@check(
    "preview_statistics",
    "items rules",
    f""", {duck.FIRST_RULE} select task_id, count(*) as total_items, count(first_rule.id) as desensitized_items,
        coalesce(string_agg(distinct first_rule.id, ',' order by first_rule.id), '') as applied_rules
    from items left join first_rule on data_type = type group by task_id""",
)
def preview_statistics(spark, sf_dir):
    stats = rewrite.preview_statistics(fx(spark, sf_dir, "items"), fx(spark, sf_dir, "rules"))
    return stats.withColumn("applied_rules", F.array_join("applied_rules", ","))


@check(
    "splice_text",
    "tasks items",
    f""", edits as (select i.task_id, t.content as text, i.start_pos as s, i.end_pos as e, '<' || i.type || '>' as nv,
            (i.id, i.start_pos, i.end_pos, i.type) as ord
        from items i join tasks t on t.id = i.task_id where t.content <> '' and i.end_pos >= i.start_pos and i.start_pos <= length(t.content)),
    {duck.sequential('edits', 'done', 'task_id')} select task_id, deid_text from done""",
)
def splice_text(spark, sf_dir):
    """Items chosen by a caller, which may overlap."""
    tasks = fx(spark, sf_dir, "tasks").where("content <> ''").select(F.col("id").alias("task_id"), F.col("content").alias("text"))
    items = fx(spark, sf_dir, "items").where("end_pos >= start_pos")
    fitting = items.join(tasks.select("task_id", F.length("text").alias("n")), "task_id").where("start_pos <= n")
    edit = F.struct("start_pos", "end_pos", F.concat(F.lit("<"), "type", F.lit(">")).alias("new_value")).cast(spans.EDIT)
    ordered = F.sort_array(F.collect_list(F.struct("id", "start_pos", "end_pos", "type", edit.alias("edit"))))
    edits = fitting.groupBy("task_id").agg(ordered.alias("xs"))
    return tasks.join(edits, "task_id").select("task_id", spans.splice_text("text", "transform(xs, x -> x.edit)").alias("deid_text"))


_EDITS = f"""{duck.FIRST_RULE}, edits as (select doc_id, s, e, {duck.rewrite('value', 'type', 'strategy')} as nv
        from merged join first_rule on data_type = type),
    known as (select * from edits where nv is not null)"""
_MERGED = f""", {duck.structured('corpus')}, {duck.ENTITY_ITEMS},
    both_items as (select * from structured union all select * from entity_items), {duck.merged('both_items')}, {_EDITS}"""


def _identified(spark, sf_dir):
    """Corpus with its items; the annotations come as an array column of the documents."""
    corpus = fx(spark, sf_dir, "corpus")
    entities = recognize.entity_items(recognize.entity_label_map(fx(spark, sf_dir, "entities")), "doc_id")
    return corpus.join(entities, "doc_id", "left").select("doc_id", "text", recognize.identify("text", "entities").alias("items"))


@check(
    "deidentify",
    "corpus entities rules",
    f"{_MERGED}, {duck.spliced('corpus', 'known')} select doc_id, deid_text from spliced",
)
def deidentify(spark, sf_dir):
    done = rewrite.deidentify(_identified(spark, sf_dir), fx(spark, sf_dir, "rules"))
    return done.select("doc_id", "deid_text")


@check(
    "preview",
    "corpus entities rules",
    f"""{_MERGED}, {duck.spliced('corpus', 'known')},
    stats as (select doc_id, count(*) as n, count(first_rule.id) as d, string_agg(distinct first_rule.id, ',' order by first_rule.id) as applied
        from merged left join first_rule on data_type = type group by doc_id)
    select corpus.doc_id, text as original, deid_text as desensitized, coalesce(n, 0) as total_items, coalesce(d, 0) as desensitized_items,
        coalesce(applied, '') as applied_rules
    from corpus join spliced using (doc_id) left join stats using (doc_id)""",
)
def preview(spark, sf_dir):
    shown = rewrite.preview(_identified(spark, sf_dir), fx(spark, sf_dir, "rules"))
    return shown.withColumn("applied_rules", F.array_join("applied_rules", ","))


@check(
    "deidentify_documents",
    "rules",
    f""", {duck.structured('documents')}, merged as (select * from structured), {_EDITS}, {duck.spliced('documents', 'known')}
    select doc_id, deid_text from spliced""",
)
def deidentify_documents(spark, sf_dir):
    """The narrow path over the given documents: no join, no shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", recognize.identify("text").alias("items"))
    return rewrite.deidentify(docs, fx(spark, sf_dir, "rules")).select("doc_id", "deid_text")


@check(
    "strategy_functions",
    "items",
    f"""select id, {duck.rewrite('value', 'type', "'mask'")} as masked, left(value, 1) || '~' || type as initial,
        case when confidence = 1.0 then left(value, 1) || '~' || type else {duck.rewrite('value', 'type', "'replace'")} end as chosen from items""",
)
def strategy_functions(spark, sf_dir):
    """A user's strategy and the given ones as SQL functions."""
    masking.register_strategy("initial", lambda value, type_: X.concat(X.left(value, 1), "~", type_))
    try:
        masking.register_functions(spark)
    finally:
        del masking.STRATEGIES["initial"]
    return spark.sql(
        """select id, inkveil_mask(value, type) as masked, inkveil_initial(value, type) as initial,
            inkveil_rewrite(value, type, if(confidence = 1.0, 'initial', 'replace')) as chosen from {items}""",
        items=fx(spark, sf_dir, "items"),
    )
