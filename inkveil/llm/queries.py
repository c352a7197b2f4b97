"""The registered queries of this package and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import bpe, conversations, counts, decontaminate, exact, interaction, language, repeats, secrets, shards, simhash, urls, warc
from inkveil.llm.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, k=2, seed=42)


@query
def op2_warc(spark, sf_dir):
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records, _ = warc.stored_records(spark, path)  # the gaps stay in the shared folder
    return warc.resolved(records).select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_page").cast("long").alias("refers_to"),
    )


ORACLES["op2_warc"] = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), g as (
  select payload_digest, payload_bytes, max(page_id) as first_id from p where payload_bytes >= 1000 group by all
)
select page_id, payload_bytes, payload_digest,
  case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from p left join g using (payload_digest, payload_bytes)
"""


def vocabulary() -> tuple[bytes, str]:
    """The contents of the rank file and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def token_digests(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """Encodes and decodes ``documents``; digests of both."""
    ranks, pattern = vocabulary()
    return bpe.encode(docs, ranks, pattern, decoded=True, block_bytes=block_bytes).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_byte_bpe(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_sharding(spark, sf_dir):
    return shards.shard(table(spark, sf_dir, "documents"), shards=16)


@query
def op6_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).drop("row_hash")


ORACLES["op6_exact_dedup"] = r"""
with plain as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
), hashed as (select doc_id, sha256(t) as text_sha256 from plain),
groups as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from hashed group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from hashed join groups using (text_sha256)
"""


@query
def op7_suffix_array_dedup(spark, sf_dir):
    made = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return made.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def revisions() -> Column:
    """Three edits of every document: an insertion from its own text, a deletion and a replacement."""
    n = F.length("text")

    def edit(seq: int, pos: Column, deleted: int, inserted: Column) -> Column:
        return F.struct(
            F.lit(seq).cast("long").alias("seq"),
            F.floor(pos).cast("long").alias("pos"),
            F.lit(deleted).cast("long").alias("deleted"),
            inserted.alias("inserted"),
        )

    return F.array(
        edit(1, n / 4, 0, F.substring("text", F.floor(n * 0.75).cast("int"), F.lit(40))),
        edit(2, n / 2, 25, F.lit("")),
        edit(3, n * 0.75, 10, F.upper(F.substring("text", 1, 15))),
    )


@query
def op8_token_counts(spark, sf_dir):
    """Counts of every document before and after its edits."""
    ranks, pattern = vocabulary()
    shared = spark.sparkContext.broadcast(ranks)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trees = docs.withColumn("tree", counts.tree_of(F.col("text"), shared, pattern)).withColumn("edits", revisions())
    state = counts.edited(F.col("text"), F.col("tree"), F.col("edits"), shared, pattern)
    return trees.select("doc_id", F.size("edits").cast("long").alias("n_edits"), state.alias("e")).select(
        "doc_id",
        "n_edits",
        F.col("e.before").alias("n_tokens"),
        F.col("e.n_tokens").alias("n_tokens_edited"),
        F.col("e.encoded").alias("n_pretokens_encoded"),
        F.sha2("e.text", 256).alias("edited_sha256"),
    )


def held_out() -> Column:
    """Documents that the language model does not learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = language.learn(docs.where(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


URL_RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


@query
def op10_url_filters(spark, sf_dir):
    """A page shows the document whose number its path names; that document's labels are the page's."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(urls.host_and_path(F.col("url"))[1], "/([0-9]+)", 1)
    shown = pages.select("url", number.try_cast("long").alias("shown"))
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").select(
        "doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad")
    )
    labelled = shown.join(labels, F.col("shown") == F.col("doc_id")).select("url", "bad")
    return urls.judge(pages, labelled, URL_RULES)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut short, repeated or given to the user, by a hash of their place."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(place.cast("binary")) % 20).alias("fate"),
    ).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query
def op11_conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    report, repaired = conversations.repair(damaged(given))
    done = report.join(
        conversations.digests(repaired).withColumnRenamed("conv_id", "of_conv"), F.col("conv_id").eqNullSafe(F.col("of_conv"))
    )
    every = given.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts_ = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        F.col("id").alias("conv_id"),
        *counts_,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _repair_sql() -> str:
    """The same edits row after row, with the cheapest way to each state (nothing, s, u, a) as a struct."""
    far = "{'cost': 1000000000::bigint, 'audit': '', 'lines': []::varchar[]}"

    def way(state: str, cost: str, letter: str, line: str | None = None) -> str:
        lines = f"{state}.lines" if line is None else f"list_append({state}.lines, {line})"
        return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'lines': {lines}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def insertion(state: str, role: str) -> str:
        return way(state, "2", "I", f"'{role}:'")

    free, extra = "fault in ('', 'truncated')", "case when fault = 'truncated' then 1 else 0 end"

    def moved(states: list[str], initial: str, role: str | None) -> list[str]:
        ways = [f"case when {free} and left(role, 1) = '{initial}' then {way(s, extra, 'K', chr(39).join(['role || ', ':', ' || txt']))} else {far} end" for s in states]
        if role:
            ways += [f"case when {free} then {way(s, f'2 + {extra}', 'R', chr(39).join(['', role + ':', ' || txt']))} else {far} end" for s in states]
        return ways

    def gone(state: str) -> str:
        return way(state, "3", "D")

    once = f"""select * replace ({least('s2', insertion('s0', 'user'), insertion('s1', 'user'), insertion('s3', 'user'))} as s2,
        {least('s3', insertion('s2', 'assistant'))} as s3)"""
    return f"""
with recursive bytes as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as txt,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place from conversations
), hashed as (
  select *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(place, ''), lambda c: ascii(c)::ubigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, case when c & 1 = 1 then 3988292384::ubigint else 0::ubigint end))),
    4294967295::ubigint) % 20 as fate from bytes
), rows as (
  select conv_id, turn, case fate when 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end as txt,
    unnest(case fate when 3 then [0, 1] else [0] end) as copy from hashed where fate <> 0
), seen as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, txt, copy) as i,
    row_number() over (partition by conv_id, role, txt order by turn nulls first, copy) as again from rows
), faulty as (
  select *, left(role, 1) || left(lead(role) over (partition by conv_id order by i), 1) as pair,
    case when not regexp_matches(txt, '[^\x20\x09-\x0D]') then 'blank' when again > 1 then 'duplicate'
      when regexp_extract(txt, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from seen
), ids as (select row_number() over () as g, conv_id from (select distinct conv_id from conversations)
), numbered as (select g, faulty.* from faulty join ids on faulty.conv_id is not distinct from ids.conv_id
), facts as (
  select g, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from numbered group by g
), ways as (
  select g, 0::bigint as i, s0, s1, s2, s3 from ({once} from ({once} from (
    select g, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as s0, {far} as s1, {far} as s2, {far} as s3 from ids)))
  union all
  select g, i, s0, s1, s2, s3 from ({once} from ({once} from (
    select g, r.i, {gone('s0')} as s0, {least(gone('s1'), *moved(['s0'], 's', None))} as s1,
      {least(gone('s2'), *moved(['s0', 's1', 's3'], 'u', 'user'))} as s2, {least(gone('s3'), *moved(['s2'], 'a', 'assistant'))} as s3
    from ways join numbered r using (g) where r.i = ways.i + 1)))
), best as (
  select g, {least('s0', 's3')} as b from ways join facts using (g) where i = n
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(b.cost, 0)::bigint as cost,
  coalesce(b.audit, '') as audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) as repaired_sha256
from ids left join facts using (g) left join best using (g)
"""


ORACLES["op11_conversation_repair"] = _repair_sql()


@query
def op12_filter_interaction(spark, sf_dir):
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_interaction"] = r"""
with plain as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), first as (select t, min(doc_id) as least from plain group by t
), good as (select distinct doc_id from labels where quality = 1), bad as (select distinct doc_id from labels where toxic = 1
), fails as (
  select part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] as f,
    doc_id in (select doc_id from good) as good, doc_id in (select doc_id from bad) as toxic
  from plain join first using (t)
), counted as (
  select part, f, count(*) as n, count(*) filter (coalesce(good, false)) as good, count(*) filter (coalesce(toxic, false)) as toxic from fails group by all
), letters as (select unnest([1, 2, 3, 4, 5]) as x
), orders as (
  select [a.x, b.x, c.x, d.x, e.x] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select o, s.x as step, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') as filter_order from orders, letters s
), each as (
  select part, filter_order, o[step] as filter, step, n, good, toxic, f, f[o[step]] as failing,
    len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 as before from counted, steps
), told as (
  select part, filter_order, step, filter, sum(n) filter (not before and not failing) as kept, sum(n) filter (failing and not before) as removed,
    sum(n) filter (failing and before) as redundant, sum(n) filter (failing and len(list_filter(f, lambda x: x)) = 1) as unique_fails,
    sum(good) filter (failing and not before) as good_lost, sum(toxic) filter (failing and not before) as toxic_lost
  from each group by all
)
select part, filter_order, step::integer as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
  coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, filter))::bigint as shapley
from told
"""


@query
def op13_secret_scan(spark, sf_dir):
    """The known forms' spans and, with the random ones, all spans of every document."""
    made = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == secrets.KINDS.index(kind))

    base = F.filter("spans", lambda s: s["kind"] < len(secrets.FORMS))
    return made.select(
        "doc_id",
        *(F.size(of(form[0])).cast("long").alias(f"n_{form[0]}") for form in secrets.FORMS),
        F.sha2(secrets.spelt(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spelt(F.col("spans")).alias("spans"),
    )
