"""Spans: finding them, keeping them apart, merging them, and rewriting them in the text.

An item is ``struct<start_pos, end_pos, type, value, confidence>``; positions are 0-based
code points, end exclusive. The position fields come first so that natural struct order is
position order. Everything here is a narrow expression on one row, and work does not grow
with the square of the text or its items, but for groups of items that overlap each other.
"""

from __future__ import annotations

from inkveil.functions import sql as F
from inkveil.functions.arrays import add, empty, gathered, larger, let, null, running
from inkveil.functions.sql import Expr, expression

SPAN = "struct<start_pos:int,end_pos:int,value:string>"
ITEM = "struct<start_pos:int,end_pos:int,type:string,value:string,confidence:double>"
EDIT = "struct<start_pos:int,end_pos:int,new_value:string>"

#: Code points per text block when cutting pieces out of a long text: ``substr`` has to walk
#: from the start of its string, so it is only ever applied to one block.
TEXT_BLOCK = 1024

#: Largest group of overlapping items decided pair by pair at once.
FOLD = 64

#: Beyond every position.
FAR = F.lit(2**31 - 1)


@expression
def find_spans(text: Expr, regex: str) -> Expr:
    """All matches of ``regex`` with their positions, as ``array<SPAN>``.

    The pieces between the matches and the matches themselves alternate, so running lengths
    give the positions. ``regex`` must not match the empty string.
    """

    def place(found: Expr) -> Expr:
        gaps = F.slice(F.split(text, regex, -1), 1, F.size(found))
        widths = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))

        def positions(ws: Expr) -> Expr:
            before = running(F.transform(ws, lambda w: w["gap"] + F.length(w["value"])), add)

            def span(w: Expr, at: Expr) -> Expr:
                start = at + w["gap"]
                return F.struct(
                    start.alias("start_pos"),
                    (start + F.length(w["value"])).alias("end_pos"),
                    w["value"].alias("value"),
                )

            return F.zip_with(ws, before, span)

        return let(widths, positions)

    return let(
        F.regexp_extract_all(text, regex, 0),
        lambda found: F.when(F.size(found) > 0, place(found)).otherwise(empty(SPAN)),
    )


def as_items(spans: Expr, type_: str | Expr, confidence: float) -> Expr:
    """Spans as items of one type."""
    kind = F.lit(type_) if isinstance(type_, str) else type_
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start_pos"].alias("start_pos"),
            s["end_pos"].alias("end_pos"),
            kind.alias("type"),
            s["value"].alias("value"),
            F.lit(float(confidence)).alias("confidence"),
        ),
    )


def overlaps(a: Expr, b: Expr) -> Expr:
    """Whether two half-open spans share a position."""
    return (a["end_pos"] > b["start_pos"]) & (a["start_pos"] < b["end_pos"])


def settle_overlaps(order: Expr, settle, item) -> Expr:
    """Items in position order with ``settle`` applied to every group of overlapping ones.

    An item starting at or after the end of all before it begins a new group, so items of
    different groups do not overlap. ``item`` gives the result element of an item that
    stands alone; without any overlap it is all that is applied.
    """

    def by_group(xs: Expr) -> Expr:
        reach = running(F.transform(xs, lambda x: x["end_pos"]), larger)
        return let(F.zip_with(xs, reach, lambda x, r: x["start_pos"] >= r), lambda first: decide(xs, first))

    def decide(xs: Expr, first: Expr) -> Expr:
        begins = F.filter(F.transform(first, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())

        def groups(bs: Expr) -> Expr:
            def one(b: Expr, j: Expr) -> Expr:
                group = F.slice(xs, b + 1, F.coalesce(F.get(bs, j + 1), F.size(xs)) - b)
                return let(group, lambda g: F.when(F.size(g) == 1, F.transform(g, item)).otherwise(settle(g)))

            return F.flatten(F.transform(bs, one))

        return F.when(F.forall(first, lambda f: f), F.transform(xs, item)).otherwise(let(begins, groups))

    return let(order, by_group)


def resolve_items(ranked: list[Expr]) -> Expr:
    """Items of several patterns without overlaps.

    The arrays in ``ranked`` are each free of overlaps, and those of an earlier array win:
    an item overlapping a kept one is dropped whole. This is decided within each group of overlapping
    items, since groups do not affect each other; the result is in position order.
    """

    def tagged(items: Expr, rank: int) -> Expr:
        return F.transform(
            items,
            lambda x: F.struct(
                x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), F.lit(rank).alias("rank"), x.alias("item")
            ),
        )

    arrays = [tagged(items, rank) for rank, items in enumerate(ranked)]

    def fold(group: Expr) -> Expr:
        by_rank = F.sort_array(
            F.transform(group, lambda x: F.struct(x["rank"].alias("rank"), x["item"].alias("item")))
        )
        return F.aggregate(
            by_rank,
            empty(ITEM),
            lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x["item"])), acc).otherwise(
                F.concat(acc, F.array(x["item"]))
            ),
        )

    def fold_unshadowed(group: Expr) -> Expr:
        best = F.transform(F.filter(group, lambda x: x["rank"] == 0), lambda x: x["item"])
        return F.concat(best, fold(F.filter(unshadowed(group), lambda x: x["rank"] > 0)))

    def by_rank(group: Expr) -> Expr:
        return F.sort_array(F.when(F.size(group) <= FOLD, fold(group)).otherwise(fold_unshadowed(group)))

    return settle_overlaps(F.sort_array(F.concat(*arrays)), by_rank, lambda x: x["item"])


def unshadowed(order: Expr) -> Expr:
    """Ranked items in position order without those overlapping an item of rank 0.

    Such an item either starts before an earlier item of rank 0 ends, or ends after the next
    one starts: a running maximum from the left and one from the right. In an endless run of
    digits this leaves next to nothing to be compared pair by pair.
    """
    ends = F.transform(order, lambda x: F.when(x["rank"] == 0, x["end_pos"]).otherwise(0))
    # Starts as distances from the far end, so that the nearest one to the right is largest.
    mirrored = F.transform(F.reverse(order), lambda x: F.when(x["rank"] == 0, FAR - x["start_pos"]).otherwise(0))
    reach = F.zip_with(
        running(ends, larger),
        F.reverse(running(mirrored, larger)),
        lambda before, after: F.struct(before.alias("before"), (FAR - after).alias("next")),
    )
    clear = F.zip_with(
        order,
        reach,
        lambda x, r: F.when((x["rank"] == 0) | ((r["before"] <= x["start_pos"]) & (r["next"] >= x["end_pos"])), x),
    )
    return F.filter(clear, lambda x: x.isNotNull())


@expression
def order_items(items: Expr, descending: bool = False) -> Expr:
    """Items by (start, end), or by start downwards; equal ones stay in input order."""
    if descending:
        keyed = F.transform(items, lambda x, i: F.struct((-x["start_pos"]).alias("a"), i.alias("i"), x.alias("item")))
    else:
        keyed = F.transform(
            items, lambda x, i: F.struct(x["start_pos"].alias("a"), x["end_pos"].alias("b"), i.alias("i"), x.alias("item"))
        )
    return F.transform(F.sort_array(keyed), lambda x: x["item"])


def merge_fold(group: Expr) -> Expr:
    """``merge_items`` of one group of overlapping items, given in order."""

    def step(last: Expr, x: Expr) -> Expr:
        clash = F.coalesce(overlaps(x, last), False)
        wins = (x["confidence"] > last["confidence"]) | (
            (x["confidence"] == last["confidence"]) & (x["confidence"] == 1.0)
        )
        settled = F.when(~clash, last).otherwise(null(ITEM))
        return F.struct(F.when(~clash | wins, x).otherwise(last).alias("state"), settled.alias("item"))

    def whole(done: Expr) -> Expr:
        return F.concat(F.filter(done["out"], lambda x: x.isNotNull()), F.array(done["state"]))

    return let(gathered(group, null(ITEM), step, ITEM), whole)


@expression
def merge_items(items: Expr) -> Expr:
    """Resolve overlaps between items of several recognisers.

    In (start, end) order, an item overlapping the last kept one takes its place when its
    confidence is higher, or when both are exactly 1.0; otherwise it is dropped. Kept items
    stay disjoint and sorted, so no earlier one can overlap.
    """
    merged = settle_overlaps(order_items(items), merge_fold, lambda x: x)
    return F.when(F.size(items) <= 1, items).otherwise(merged)


def _cut(env: Expr, start: Expr, end: Expr) -> Expr:
    """``text[start:end]`` from the text blocks of ``env``."""
    b = TEXT_BLOCK
    stop = F.least(end, env["len"])
    first = start // b
    last = (stop - 1) // b
    blocks = env["blocks"]
    within = F.substr(F.get(blocks, first), start % b + 1, stop - start)
    across = F.concat(
        F.substr(F.get(blocks, first), start % b + 1, b),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, 0)), ""),
        F.substr(F.get(blocks, last), 1, (stop - 1) % b + 1),
    )
    return F.when(stop <= start, "").when(first == last, within).otherwise(across)


@expression
def splice_text(text: Expr, edits: Expr) -> Expr:
    """Rewrite the spans of ``edits`` (``array<EDIT>``) in ``text``.

    Equal to replacing one edit after the other from the highest start down to the lowest,
    equal starts in input order, each on the result of the one before; this matters only for
    overlapping edits. Read from the left, every edit puts its new value before the rest of
    the stream (text and later values) and removes as many code points of it as the span is
    long, so one running count of code points still to skip carries the whole state.
    Disjoint edits, which all recognisers deliver, never carry anything over.
    """

    def disjoint(env: Expr) -> Expr:
        xs = env["edits"]
        return F.transform(
            xs,
            lambda x, i: F.concat(_cut(env, F.coalesce(F.get(xs, i - 1)["e"], 0), x["s"]), x["v"]),
        )

    def overlapping(env: Expr) -> Expr:
        def step(state: Expr, x: Expr) -> Expr:
            gap = x["s"] - state["at"]
            in_gap = F.least(state["skip"], gap)
            left = state["skip"] - in_gap
            piece = F.struct((state["at"] + in_gap).alias("a"), x["s"].alias("z"), left.alias("cut"))
            skip = F.greatest(left - F.length(x["v"]), 0) + x["e"] - x["s"]
            return F.struct(F.struct(x["s"].alias("at"), skip.alias("skip")).alias("state"), piece.alias("item"))

        def render(done: Expr) -> Expr:
            body = F.zip_with(
                done["out"],
                env["edits"],
                lambda p, x: F.concat(
                    _cut(env, p["a"], p["z"]), F.substr(x["v"], p["cut"] + 1, F.length(x["v"]))
                ),
            )
            rest = _cut(env, done["state"]["at"] + done["state"]["skip"], env["len"])
            return F.concat(F.array_join(body, ""), rest)

        init = F.struct(F.lit(0).alias("at"), F.lit(0).alias("skip"))
        return let(gathered(env["edits"], init, step, "struct<a:int,z:int,cut:int>"), render)

    def run(env: Expr) -> Expr:
        xs = env["edits"]
        clash = F.exists(
            F.transform(xs, lambda x, i: F.coalesce(F.get(xs, i - 1)["e"] > x["s"], False)), lambda c: c
        )
        plain = F.concat(F.array_join(disjoint(env), ""), _cut(env, F.element_at(xs, -1)["e"], env["len"]))
        return F.when(clash, overlapping(env)).otherwise(plain)

    def bound(found: Expr) -> Expr:
        order = F.sort_array(
            F.transform(
                found,
                lambda x, i: F.struct(
                    x["start_pos"].alias("s"), (-i).alias("i"), x["end_pos"].alias("e"), x["new_value"].alias("v")
                ),
            )
        )
        env = F.struct(
            order.alias("edits"),
            F.regexp_extract_all(text, f"(?s).{{1,{TEXT_BLOCK}}}", 0).alias("blocks"),
            F.length(text).alias("len"),
        )
        return F.when(F.size(found) > 0, let(env, run)).otherwise(text)

    return let(edits, bound)
