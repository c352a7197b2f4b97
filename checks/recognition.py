"""Recognition: patterns, priorities, entities, merging."""

import re

from pyspark.sql import functions as F

from checks import duck
from checks.fixtures import fx, given
from checks.registry import check
from inkveil.functions import patterns, spans
from inkveil.functions.sql import Expr
from inkveil.operators import merge, recognize, recognizers
from inkveil.operators.rows import explode_rows


def _item_columns():
    return [
        F.col("x.start_pos").cast("bigint").alias("start_pos"),
        F.col("x.end_pos").cast("bigint").alias("end_pos"),
        F.col("x.type").alias("type"),
        F.col("x.value").alias("value"),
        F.col("x.confidence").alias("confidence"),
    ]


_ITEMS_SQL = "select doc_id, s as start_pos, e as end_pos, type, value, conf as confidence from"


def _exploded(df, items="items"):
    return explode_rows(df, ["doc_id"], items, "i", "x").select("doc_id", *_item_columns())


def _find_check(kind):
    sql = f""", {duck.matches('corpus', duck.REGEX[kind], 'm')}
        select doc_id, s as start_pos, e as end_pos, value from m"""

    @check(f"find_{kind}", "corpus", sql)
    def query(spark, sf_dir):
        found = fx(spark, sf_dir, "corpus").select("doc_id", patterns.find_type("text", kind).alias("items"))
        return _exploded(found).drop("type", "confidence")


for _kind in ("id_card", "bank_card", "phone", "email"):
    _find_check(_kind)


@check("find_structured", "corpus", f", {duck.structured('corpus')} {_ITEMS_SQL} structured")
def find_structured(spark, sf_dir):
    found = fx(spark, sf_dir, "corpus").select("doc_id", patterns.find_structured("text").alias("items"))
    return _exploded(found)


@check(
    "priority_overlap_anti",
    "corpus",
    f""", {duck.structured('corpus')} select doc_id, s as start_pos, e as end_pos, type, value from structured""",
)
def priority_overlap_anti(spark, sf_dir):
    ranked = [patterns.find_type(Expr("text"), kind) for kind in ("id_card", "bank_card", "phone", "email")]
    kept = fx(spark, sf_dir, "corpus").select("doc_id", spans.resolve_items(ranked).column.alias("items"))
    return _exploded(kept).drop("confidence")


def _all_tables():
    """The structured recogniser over the other texts: pages as they are, benchmark items with numbers of their own."""
    for name, table, key, text in (("pages", "", "page_id", "html"), ("benchmark", "benchmark_pii", "item_id", "text")):
        sql = f", {duck.structured(table or name, key, text)} select {key}, s as start_pos, e as end_pos, type, value from structured"

        def query(spark, sf_dir, name=name, table=table, key=key, text=text):
            texts = fx(spark, sf_dir, table) if table else given(spark, sf_dir, name)
            found = explode_rows(texts, [key], patterns.find_structured(text), "i", "x")
            return found.select(key, *_item_columns()).drop("confidence")

        check(f"find_structured_{name}", table, sql)(query)


_all_tables()


@check(
    "entity_label_map",
    "entities",
    f", {duck.ENTITY_ITEMS} {_ITEMS_SQL} entity_items",
)
def entity_label_map(spark, sf_dir):
    items = recognize.entity_label_map(fx(spark, sf_dir, "entities"))
    return items.select(
        "doc_id", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"),
        "type", "value", "confidence",
    )


_TERMS = (
    "terms as (select string_agg(n_name, '|' order by length(n_name) desc, n_name) as rx from nation)"
)


@check(
    "gazetteer_match",
    "corpus",
    f""", {_TERMS}, raw as (select doc_id, regexp_extract_all(text, rx) as v, string_split_regex(text, rx) as g from corpus, terms),
    each as (select doc_id, unnest(v) as value, unnest(g[1:len(v)]) as gap, unnest(range(len(v))) as i from raw where len(v) > 0)
    select doc_id, cast(upto - length(value) as bigint) as start_pos, cast(upto as bigint) as end_pos, 'address' as type, value,
        0.8::double as confidence
    from (select *, sum(length(gap) + length(value)) over (partition by doc_id order by i) as upto from each)""",
)
def gazetteer_match(spark, sf_dir):
    terms = recognize.vocabulary(given(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lit("address").alias("type")))
    found = fx(spark, sf_dir, "corpus").select("doc_id", recognize.gazetteer("text", terms).alias("items"))
    return _exploded(found)


_BOTH = f"{duck.structured('corpus')}, {duck.ENTITY_ITEMS}, both_items as (select * from structured union all select * from entity_items)"


@check("union_items", "corpus entities", f", {_BOTH} {_ITEMS_SQL} both_items")
def union_items(spark, sf_dir):
    found = recognize.identify_with_annotations(fx(spark, sf_dir, "corpus"), fx(spark, sf_dir, "entities"))
    return _exploded(found.select("doc_id", recognize.union_items("structured", "entities").alias("items")))


@check("identify", "corpus entities", f", {_BOTH}, {duck.merged('both_items')} {_ITEMS_SQL} merged")
def identify(spark, sf_dir):
    return _exploded(recognize.identify_with_annotations(fx(spark, sf_dir, "corpus"), fx(spark, sf_dir, "entities")))


@check(
    "recognizer_fallback",
    "corpus entities",
    f""", {_BOTH}, {duck.merged('both_items')} {_ITEMS_SQL} structured
        where doc_id % 3 = 0 union all {_ITEMS_SQL} merged where doc_id % 3 <> 0""",
)
def recognizer_fallback(spark, sf_dir):
    """The entity recogniser failed (null instead of an array) for a third of the documents."""
    entities = recognize.entity_items(recognize.entity_label_map(fx(spark, sf_dir, "entities")), "doc_id")
    broken = entities.withColumn("entities", F.when(F.col("doc_id") % 3 != 0, F.col("entities")))
    both = fx(spark, sf_dir, "corpus").join(broken, "doc_id", "left")
    items = recognize.identify("text", "entities")
    return _exploded(both.select("doc_id", items.alias("items")))


@check(
    "merge_items",
    "items",
    f""", valid as (select task_id as doc_id, start_pos::bigint as s, end_pos::bigint as e, type, value, confidence as conf, 0 as src
        from items where end_pos >= start_pos), {duck.merged('valid')} {_ITEMS_SQL} merged""",
)
def merge_items(spark, sf_dir):
    valid = fx(spark, sf_dir, "items").where("end_pos >= start_pos").withColumnRenamed("task_id", "doc_id")
    grouped = recognize.entity_items(valid, "doc_id")
    return _exploded(grouped.select("doc_id", spans.merge_items("entities").alias("items")))


@check(
    "merge_item_table",
    "items",
    f""", valid as (select task_id as doc_id, start_pos::bigint as s, end_pos::bigint as e, type, value, confidence as conf, 0 as src
        from items where end_pos >= start_pos), {duck.merged('valid')} {_ITEMS_SQL} merged""",
)
def merge_item_table(spark, sf_dir):
    valid = fx(spark, sf_dir, "items").where("end_pos >= start_pos").withColumnRenamed("task_id", "doc_id")
    kept = merge.merge_item_table(valid)
    return kept.withColumns({c: F.col(c).cast("bigint") for c in ("start_pos", "end_pos")})


@check(
    "recognition_counts",
    "corpus entities",
    f""", {_BOTH}, {duck.merged('both_items')},
    counts as (select doc_id, count(*) filter (src = 0) as r, count(*) filter (src = 1) as n from both_items group by doc_id),
    m as (select doc_id, count(*) as n from merged group by doc_id)
    select corpus.doc_id, coalesce(counts.r, 0) as regex_items, coalesce(counts.n, 0) as nlp_items,
        coalesce(counts.r + counts.n, 0) as total_items, coalesce(m.n, 0) as merged_items
    from corpus left join counts using (doc_id) left join m using (doc_id)""",
)
def recognition_counts(spark, sf_dir):
    found = recognize.identify_with_annotations(fx(spark, sf_dir, "corpus"), fx(spark, sf_dir, "entities"))
    counts = recognize.recognition_counts(found)
    return counts.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in counts.columns[1:]])


def _ordered(descending):
    def query(spark, sf_dir):
        rows = fx(spark, sf_dir, "items").where("end_pos >= start_pos")
        item = F.struct("start_pos", "end_pos", "type", "value", "confidence").cast(spans.ITEM)
        # Input order: by id.
        grouped = rows.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("id", item.alias("item")))).alias("xs"))
        order = spans.order_items("transform(xs, x -> x.item)", descending)
        return explode_rows(grouped, ["task_id"], order, "n", "x").select(
            "task_id", F.col("n").cast("bigint").alias("n"), *_item_columns()
        )

    return query


def _order_sql(order):
    # Equal items keep their input order, which is by id, then by the fields.
    return f"""select task_id, row_number() over (partition by task_id order by {order}, id, start_pos, end_pos, type, value, confidence) - 1 as n,
        start_pos::bigint as start_pos, end_pos::bigint as end_pos, type, value, confidence
        from items where end_pos >= start_pos"""


check("order_items", "items", _order_sql("start_pos, end_pos"))(_ordered(False))
check("order_items_desc", "items", _order_sql("start_pos desc"))(_ordered(True))


_PHRASES = """phrases as (select distinct array_to_string(w[i:i + 2], ' ') as term from (select w, unnest(range(1, len(w) - 1)) as i from (
        select string_split(text, ' ') as w from conversations union all select string_split(text, ' ') from benchmark)))"""


@check(
    "gazetteer_many_terms",
    "",
    f""", {_PHRASES}, kinds as (select term, case when length(term) % 2 = 0 then 'name' else 'address' end as kind, length(term) as n from phrases),
    firsts as (select left(term, 5) as prefix, list(distinct n) as sizes from kinds group by 1),
    placed as (select doc_id, text, unnest(range(1, length(text) - 3)) as s from documents),
    begun as (select doc_id, s, unnest(sizes) as n, text from placed join firsts on substr(text, s, 5) = prefix),
    hits as (select doc_id, s, max(kinds.n) as n from begun join kinds on kinds.n = begun.n and substr(text, s, begun.n) = term group by 1, 2),
    steps as (select doc_id, list(struct_pack(s := s, n := n) order by s) as hs from hits group by 1),
    kept as (select doc_id, unnest(list_reduce(list_prepend([{{'s': 0::bigint, 'n': 0::bigint}}], list_transform(hs, lambda h: [h])),
        lambda a, b: case when b[1].s >= a[len(a)].s + a[len(a)].n then list_append(a, b[1]) else a end)) as h from steps)
    select doc_id, h.s - 1 as start_pos, h.s - 1 + h.n as end_pos, kind as type, term as value, 0.8::double as confidence
    from kept join documents using (doc_id) join kinds on term = substr(text, h.s, h.n) where h.n > 0""",
)
def gazetteer_many_terms(spark, sf_dir):
    """Every three neighbouring words of conversations and benchmark items as a term, searched in all documents."""
    texts = given(spark, sf_dir, "conversations").select("text").unionByName(given(spark, sf_dir, "benchmark").select("text"))
    words = texts.select(F.split("text", " ").alias("w")).where("size(w) > 2")
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    terms = words.select(F.explode(F.array_distinct(three)).alias("term")).distinct()
    kind = F.when(F.length("term") % 2 == 0, "name").otherwise("address")
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    return _exploded(recognize.gazetteer_items(docs, terms.select("term", kind.alias("type"))))


_LOCAL_PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


@check(
    "find_own_pattern",
    "",
    f""", {duck.structured('documents')}, {duck.matches('documents', _LOCAL_PHONE, 'own')}
    select doc_id, s as start_pos, e as end_pos, type, value, conf as confidence from structured
    union all select doc_id, s, e, 'local_phone', value, 0.9::double from own where not exists (
        select 1 from structured k where k.doc_id = own.doc_id and k.s < own.e and own.s < k.e)""",
)
def find_own_pattern(spark, sf_dir):
    """A user's pattern after the given ones."""
    own = [*patterns.PATTERNS, patterns.Pattern("local_phone", _LOCAL_PHONE, "+1 (", needs_literal=True, confidence=0.9)]
    found = given(spark, sf_dir, "documents").select("doc_id", patterns.find_structured("text", own).alias("items"))
    return _exploded(found)


def nations(text):
    """A recogniser by rule; it cannot read emoji."""
    if "\N{GRINNING FACE}" in text:
        raise ValueError("no emoji")
    return [(m.start(), m.end(), "LOC" if int(m[1]) % 2 else "TEAM") for m in re.finditer(r"NATION_(\d+)", text)]


@check(
    "recognize_texts",
    "corpus",
    f""", fine as (select * from corpus where not contains(text, '😀')), {duck.matches('fine', 'NATION_[0-9]+', 'm')}
    select doc_id, case when substr(value, 8)::bigint % 2 = 1 then 'LOC' else 'TEAM' end as label, s::integer as start_pos, e::integer as end_pos, value, null as error from m
    union all select doc_id, null, null, null, null, 'ValueError: no emoji' from corpus where contains(text, '😀')""",
)
def recognize_texts(spark, sf_dir):
    """A user's recogniser as a table function in SQL; its failures are rows."""
    spark.udtf.register("inkveil_nations", recognizers.recognizer(nations))
    return spark.sql(
        "select d.doc_id, r.* from {docs} d, lateral inkveil_nations(d.text) r", docs=fx(spark, sf_dir, "corpus").select("doc_id", "text")
    )
