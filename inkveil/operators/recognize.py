"""Recognition over tables of documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.constants import ENTITY_CONFIDENCE, ENTITY_TYPES
from inkveil.functions import sql as X
from inkveil.functions.arrays import empty
from inkveil.functions.patterns import Pattern, find_and_merge, find_structured
from inkveil.functions.spans import ITEM, find_spans, merge_items
from inkveil.functions.sql import Expr, expression
from inkveil.operators.gazetteer import find_terms, size_of, stored
from inkveil.operators.rows import explode_rows

#: Terms, and letters in all of them, that may go into the plan as one pattern.
LITERAL_TERMS = 10_000
LITERAL_LETTERS = 500_000


def entity_label_map(annotations: DataFrame) -> DataFrame:
    """Entity annotations (key, label, start_pos, end_pos, value) as items; other labels go."""
    kind = None
    for label, name in ENTITY_TYPES.items():
        kind = F.when(F.col("label") == label, name) if kind is None else kind.when(F.col("label") == label, name)
    typed = annotations.where(F.col("label").isin(list(ENTITY_TYPES)))
    return typed.withColumn("type", kind).withColumn("confidence", F.lit(ENTITY_CONFIDENCE)).drop("label")


def entity_items(entities: DataFrame, key: str) -> DataFrame:
    """(key, entities, entity_count): the items of an item table as one array per document.

    Copies of an item are combined before anything is gathered: the merge keeps one of them,
    so the array holds at most the distinct items of one document. Empty spans overlap
    nothing, not even each other, and so keep their copies. ``entity_count`` counts all
    copies. The array is sorted by its fields, whatever order the rows arrive in.
    """
    fields = ["start_pos", "end_pos", "type", "value", "confidence"]
    distinct = entities.groupBy(key, *fields).agg(F.count(F.lit(1)).alias("n"))
    copies = F.when(F.col("start_pos") == F.col("end_pos"), F.col("n").cast("int")).otherwise(F.lit(1))
    kept = F.array_repeat(F.struct(*fields).cast(ITEM), copies)
    return distinct.groupBy(key).agg(
        F.sort_array(F.flatten(F.collect_list(kept))).alias("entities"), F.sum("n").alias("entity_count")
    )


@expression
def union_items(structured: Expr, entities: Expr) -> Expr:
    """Items of both recognisers, pattern items first; no entities counts as none found."""
    return X.concat(structured, X.coalesce(entities, empty(ITEM)))


@expression
def identify(text: Expr, entities: Expr | None = None, patterns: list[Pattern] | None = None) -> Expr:
    """Items of a text: pattern items, merged with entity items where given.

    Pattern items alone are disjoint already. A missing entity array (recogniser failed or
    found nothing) leaves the pattern items.
    """
    if entities is None:
        return find_structured(text, patterns)
    return find_and_merge(text, X.coalesce(entities, empty(ITEM)), patterns)


def identify_with_annotations(docs: DataFrame, annotations: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, structured, entities, entity_count, items) of documents and an annotation table.

    The patterns run before the join, so the shuffle moves the found items, not the texts.
    """
    entities = entity_items(entity_label_map(annotations), key)
    found = docs.select(key, find_structured(text).alias("structured"))
    joined = found.join(entities, key, "left").select(
        key,
        "structured",
        F.coalesce("entities", empty(ITEM).column).alias("entities"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"),
    )
    return joined.withColumn("items", merge_items("concat(structured, entities)"))


def vocabulary(terms: DataFrame) -> list[tuple[str, str]]:
    """The (term, type) pairs of a term table, for ``gazetteer``.

    The list is configuration of the job and goes into the plan. A term with several types has the smallest
    of them; null and empty terms are left out.
    """
    rows = terms.where("term <> '' and type is not null").groupBy("term").agg(F.min("type").alias("type"))
    return [(r["term"], r["type"]) for r in rows.collect()]


def trie_regex(terms: list[str]) -> str:
    """A regex for any of the terms that shares their beginnings, so that a position is tried once per letter.

    At each position it matches the longest term.
    """
    root: dict = {}
    for term in terms:
        node = root
        for letter in term:
            node = node.setdefault(letter, {})
        node[""] = {}

    def quoted(letter: str) -> str:
        return "\\" + letter if letter.isascii() and not letter.isalnum() and letter != "_" else letter

    # from the longest beginnings up, without recursion, since terms may be long
    parts: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack.extend((child, False) for letter, child in node.items() if letter)
            continue
        arms = [quoted(letter) + parts.pop(id(child)) for letter, child in sorted(node.items()) if letter]
        if not arms:
            parts[id(node)] = ""
        elif len(arms) == 1 and "" not in node:
            parts[id(node)] = arms[0]
        else:
            parts[id(node)] = f"(?:{'|'.join(arms)}){'?' if '' in node else ''}"
    return parts[id(root)]


@expression
def gazetteer(text: Expr, terms: list[tuple[str, str]]) -> Expr:
    """Items for the occurrences of (term, type) pairs, without overlaps.

    Stands in for a trained recogniser. At each position the longest term is found, whatever the number of
    terms; one with several types has the smallest of them.
    """
    kinds: dict[str, str] = {}
    for term, kind in terms:
        if not term:
            raise ValueError("an empty term occurs everywhere")
        kinds[term] = min(kind, kinds.get(term, kind))
    if not kinds:
        return empty(ITEM)
    type_of = X.from_json(X.lit(json.dumps(kinds, ensure_ascii=False)), X.lit("map<string,string>"))

    def item(span: Expr) -> Expr:
        return X.struct(
            span["start_pos"].alias("start_pos"),
            span["end_pos"].alias("end_pos"),
            X.element_at(type_of, span["value"]).alias("type"),
            span["value"].alias("value"),
            X.lit(ENTITY_CONFIDENCE).alias("confidence"),
        )

    return X.coalesce(X.transform(find_spans(text, trie_regex(list(kinds))), item), empty(ITEM))


def gazetteer_items(
    docs: DataFrame, terms: DataFrame, text: str = "text", items: str = "items", literal_terms: int = LITERAL_TERMS, **bounds: int
) -> DataFrame:
    """``docs`` with the column ``items``: what ``gazetteer`` finds of a term table (term, type) of any size.

    Terms counted as few go into the plan as a pattern; the others are searched for by hashes, see
    ``inkveil.operators.gazetteer``, whose ``bounds`` may be given.
    """
    known = terms.where("term <> '' and type is not null").groupBy("term").agg(F.min("type").alias("type"))
    known = stored(known, "gazetteer-terms")  # before they are counted, so that they are shuffled once
    size = size_of(known)
    if size[0] <= literal_terms and size[1] <= LITERAL_LETTERS:
        return docs.withColumn(items, gazetteer(text, vocabulary(terms)))
    return find_terms(docs, known, text, items, size, **bounds)


def explode_items(docs: DataFrame, key: str = "doc_id", items: str = "items") -> DataFrame:
    """Item table of a column of item arrays; ids are derived, so a retry writes the same."""
    x = F.col("x")
    return explode_rows(docs, [key], items, "i", "x").select(
        F.sha2(F.concat_ws("\u0001", F.col(key).cast("string"), x["type"], x["start_pos"].cast("string"), x["end_pos"].cast("string"), F.col("i").cast("string")), 256).alias("id"),
        key,
        x["type"].alias("type"),
        x["value"].alias("value"),
        x["start_pos"].alias("start_pos"),
        x["end_pos"].alias("end_pos"),
        x["confidence"].alias("confidence"),
    )


def recognition_counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Items per document by recogniser, in total, and after the merge."""
    return found.select(
        key,
        F.size("structured").alias("regex_items"),
        F.col("entity_count").alias("nlp_items"),
        (F.size("structured") + F.col("entity_count")).alias("total_items"),
        F.size("items").alias("merged_items"),
    )

