"""Repair of conversation structure by cheapest edits.

Rows of a conversation are taken in the order of their turns and checked; then the cheapest edits are found
after which the initials of the roles read ``(s?(ua)+)?``. A row is kept, given another role (user or
assistant) or deleted, and empty user or assistant rows are inserted. Blank and repeated rows must go.

The edits are a path through a small acyclic graph: a node is a row and one of four states (nothing yet, after
a system row, after a user row, after an assistant row), an edge is one edit with its letter ``D I K R``. Every
path has one scalar weight, a big integer: its high digits are the cost, its low digits spell the audit
letters at fixed places, three bits each, the first letter highest and zeros after the last. So an ordinary
minimum of integers decides cost and ties at once; putting an edit before a path moves its letters one place
down. Two paths of equal cost between the same nodes never begin with one another, as letters fix the path and
an insertion costs something. Therefore weights of adjoining stretches add up as well, and a conversation may
be cut anywhere: each part gives its cheapest paths from every state to every state, and parts are joined by
the minimum over the state between them.

Rows are dealt by ranges of (conversation, turn, …) and cut into parts of bounded size, so a conversation of
any length is spread over tasks. Most conversations lie in one part and are solved where they are; only those in
several are joined, in rounds of bounded groups.

Defined cases: null roles and texts count as one space; a null conversation is one like any other; null turns
come first and are no gaps; rows of the same turn are ordered by role, then by the first 32 characters of
their text, then by a hash of it; repeated rows are rows of their own; an empty role fits no state; texts of
any length are taken whole; an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.shared import small, stored

#: Rows and characters in a part of a conversation.
PART_ROWS = 256
PART_LETTERS = 1 << 20
#: Parts of a conversation that are joined at a time.
FAN = 64

# Costs of the edits, and digits that keep the order of their letters.
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
TRUNCATED_COST = 1

BITS = 3
STATES = 4  # nothing yet, after system, after user, after assistant
#: What may come after each state.
FOLLOWING = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The role that an inserted row or one with a new role has after each state.
NEXT_ROLE = ["user", "user", "assistant", "user"]
ACCEPTED = (0, 3)
LEGAL = {"su", "ua", "au"}

INITIALS = "sua-"
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
_SPELL = str.maketrans("1234", "DIKR")
_DIGITS = str.maketrans("DIKR", "1234")


def code_of(role: str, fault: int) -> str:
    """A row as one letter: the initial of its role, and its fault."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return chr(ord("A") + 4 * INITIALS.index(initial) + fault)


def decoded(code: str) -> tuple[str, int]:
    number = ord(code) - ord("A")
    return INITIALS[number // 4], number % 4


def cheapest(codes: str, ends: tuple[int, ...]) -> list[tuple[int, str] | None]:
    """Cost and letters of the cheapest path over the rows from each state to one of ``ends``."""
    places = 3 * len(codes) + 2  # two insertions at most before each row and at the end
    low = (1 << BITS * places) - 1
    far = 1 << BITS * places + 62
    edge = {
        (letter, extra): (COST[letter] + extra << BITS * places) + (DIGIT[letter] << BITS * (places - 1))
        for letter in "DIKR"
        for extra in (0, TRUNCATED_COST)
    }

    def before(letter: str, path: int, extra: int = 0) -> int:
        spelt = path & low
        return far if path >= far else path - spelt + edge[letter, extra] + (spelt >> BITS)

    def with_insertions(paths: list[int]) -> list[int]:
        for _ in range(2):
            paths = [min(p, before("I", paths[FOLLOWING[s].get("a") or FOLLOWING[s]["u"]])) for s, p in enumerate(paths)]
        return paths

    paths = with_insertions([0 if s in ends else far for s in range(STATES)])
    for code in reversed(codes):
        initial, fault = decoded(code)
        made = []
        for state in range(STATES):
            choices = [before("D", paths[state])]
            if fault in (FINE, TRUNCATED):
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                choices.append(before("R", paths[FOLLOWING[state].get("a") or FOLLOWING[state]["u"]], extra))
                if initial in FOLLOWING[state]:
                    choices.append(before("K", paths[FOLLOWING[state][initial]], extra))
            made.append(min(choices))
        paths = with_insertions(made)
    return [None if p >= far else (p >> BITS * places, f"{p & low:0{places}o}".rstrip("0").translate(_SPELL)) for p in paths]


@functools.lru_cache(maxsize=1 << 15)
def whole_path(codes: str) -> tuple[int, str]:
    """Cost and letters for a whole conversation."""
    return cheapest(codes, ACCEPTED)[0]


def path_table(codes: str) -> list[dict | None]:
    """Cost and letters from each state to each state, row by row."""
    by_end = [cheapest(codes, (end,)) for end in range(STATES)]
    return [
        None if by_end[e][s] is None else {"cost": by_end[e][s][0], "letters": by_end[e][s][1], "states": f"{s}{e}"}
        for s in range(STATES)
        for e in range(STATES)
    ]


def joined_paths(first: list[dict | None], second: list[dict | None]) -> list[dict | None]:
    """The table of two adjoining stretches: the least sum of weights over the state between them."""
    places = max(len(p["letters"]) for p in first if p) + max(len(p["letters"]) for p in second if p)

    def weight(path: dict, skipped: int) -> int:
        spelt = path["letters"].translate(_DIGITS)
        return (path["cost"] << BITS * places) + (int(spelt or "0", 8) << BITS * (places - skipped - len(spelt)))

    out: list[dict | None] = []
    for s in range(STATES):
        for e in range(STATES):
            best = None
            for m in range(STATES):
                a, b = first[STATES * s + m], second[STATES * m + e]
                if a and b:
                    total = weight(a, 0) + weight(b, len(a["letters"]))
                    if best is None or total < best[0]:
                        best = (total, a, b)
            out.append(
                best and {"cost": best[1]["cost"] + best[2]["cost"], "letters": best[1]["letters"] + best[2]["letters"],
                          "states": best[1]["states"] + best[2]["states"][1:]}
            )
    return out


def facts_of(codes: str, initials: list[str], turns: list[int | None]) -> dict:
    """Counts of a stretch, and what is needed to add those of the next one."""
    faults = [decoded(c)[1] for c in codes]
    known = [t for t in turns if t is not None]
    return {
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first_initial": initials[0],
        "last_initial": initials[-1],
        "first_turn": known[0] if known else None,
        "last_turn": known[-1] if known else None,
        "turns": len(set(known)),
    }


def joined_facts(a: dict, b: dict) -> dict:
    out = {name: a[name] + b[name] for name in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    first, last = a["first_turn"], b["last_turn"]
    return out | {
        "first_initial": a["first_initial"],
        "last_initial": b["last_initial"],
        "first_turn": b["first_turn"] if first is None else first,
        "last_turn": a["last_turn"] if last is None else last,
    }


FACTS = pa.struct(
    [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
    + [("first_initial", pa.string()), ("last_initial", pa.string())]
    + [(n, pa.int64()) for n in ("first_turn", "last_turn", "turns")]
)
PATHS = pa.list_(pa.struct([("cost", pa.int64()), ("letters", pa.string()), ("states", pa.string())]))
ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FACTS = "struct<blank:long,duplicate:long,truncated:long,illegal:long,first_initial:string,last_initial:string,first_turn:long,last_turn:long,turns:long>"
_PATHS = "array<struct<cost:long,letters:string,states:string>>"
_ROWS = "array<struct<role:string,text:string>>"
_SOLVED = f"struct<facts:{_FACTS},cost:long,letters:string,rows:{_ROWS}>"
_TABLED = f"struct<facts:{_FACTS},paths:{_PATHS}>"


def edited(state: int, letters: str, roles: list[str], texts: list[str]) -> list[dict]:
    """The rows that the edits give, from ``state`` on."""
    out, rows = [], iter(zip(roles, texts))
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter in "IR":
            role = NEXT_ROLE[state]
        state = FOLLOWING[state][role[0]]
        out.append({"role": role, "text": text})
    return out


def _cut(part_rows: int):
    """Parts of rows that come in order: (conv, part, turns, roles, texts, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last = re.compile("[^\x20\x09-\x0d]")
        part = TaskContext.get().partitionId() << 32
        conv, size, seen = None, 0, set()
        held: tuple[list, list, list, list] = ([], [], [], [])
        schema = pa.schema(
            [("conv", pa.string()), ("part", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
             ("texts", pa.list_(pa.string())), ("codes", pa.string())]
        )
        made: list[dict] = []

        def close() -> None:
            nonlocal part, size, held, seen
            if held[0]:
                turns, roles, texts, codes = held
                made.append({"conv": conv, "part": part, "turns": turns, "roles": roles, "texts": texts, "codes": "".join(codes)})
                part += 1
            size, held, seen = 0, ([], [], [], []), set()

        for batch in batches:
            for own, turn, role, text in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if own != conv or len(held[0]) >= part_rows or size >= PART_LETTERS:
                    close()
                    conv = own
                kept = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
                if not last.search(kept[-1:]):
                    fault = BLANK
                elif (role, text) in seen:
                    fault = DUPLICATE
                else:
                    fault = FINE if kept[-1] in ".!?" else TRUNCATED
                    seen.add((role, text))
                for column, value in zip(held, (turn, role, text, code_of(role, fault))):
                    column.append(value)
                size += len(role) + len(text)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
                made.clear()
        close()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


def _solved(turns: pa.Array, roles: pa.Array, texts: pa.Array, codes: pa.Array) -> pa.Array:
    """A conversation that is one part."""
    facts, costs, audits, rows = [], [], [], []
    for t, r, x, c in zip(turns.to_pylist(), roles.to_pylist(), texts.to_pylist(), codes.to_pylist()):
        facts.append(facts_of(c, [role[:1] for role in r], t))
        cost, letters = whole_path(c)
        costs.append(cost)
        audits.append(letters)
        rows.append(edited(0, letters, r, x))
    return pa.StructArray.from_arrays(
        [pa.array(facts, FACTS), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(rows, ROWS)],
        ["facts", "cost", "letters", "rows"],
    )


def _tabled(turns: pa.Array, roles: pa.Array, codes: pa.Array, late: pa.Array) -> pa.Array:
    """A part of a conversation; ``late`` are the rows that an earlier part has as well."""
    facts, paths = [], []
    for t, r, c, again in zip(turns.to_pylist(), roles.to_pylist(), codes.to_pylist(), late.to_pylist()):
        own = list(c)
        for i in again or []:
            own[i] = code_of(r[i], DUPLICATE)
        facts.append(facts_of("".join(own), [role[:1] for role in r], t))
        paths.append(path_table("".join(own)))
    return pa.StructArray.from_arrays([pa.array(facts, FACTS), pa.array(paths, PATHS)], ["facts", "paths"])


def _joined(parts: pa.Array) -> pa.Array:
    """Adjoining parts, in order, as one."""
    facts, paths = [], []
    for group in parts.to_pylist():
        facts.append(functools.reduce(joined_facts, (p["facts"] for p in group)))
        for part in group:  # states between these parts are wanted, not those within them
            for n, path in enumerate(part["paths"]):
                if path:
                    path["states"] = f"{n // STATES}{n % STATES}"
        paths.append(functools.reduce(joined_paths, (p["paths"] for p in group)))
    return pa.StructArray.from_arrays([pa.array(facts, FACTS), pa.array(paths, PATHS)], ["facts", "paths"])


def _edited(start: pa.Array, letters: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.Array:
    return pa.array([edited(*row) for row in zip(*(c.to_pylist() for c in (start, letters, roles, texts)))], ROWS)


def _parts(rows: DataFrame, part_rows: int) -> DataFrame:
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.left("text", F.lit(32)), F.xxhash64("text")]
    spread = F.monotonically_increasing_id()  # equal rows need not meet
    dealt = rows.withColumn("_spread", spread).repartitionByRange(*order, "_spread").sortWithinPartitions(*order, "text")
    cut = dealt.select("conv", "turn", "role", "text").mapInArrow(
        _cut(part_rows), "conv string, part long, turns array<long>, roles array<string>, texts array<string>, codes string"
    )
    return stored(cut, "conversation-parts")


def _late(parts: DataFrame) -> DataFrame:
    """``of_part`` and ``late``: rows of parts that repeat a row of an earlier part of their conversation."""
    each = parts.select("conv", "part", F.posexplode(F.arrays_zip("roles", "texts", F.split("codes", "").alias("code"))).alias("at", "x"))
    first = each.where((F.ascii("x.code") - ord("A")) % 4 <= TRUNCATED)  # the first of its part, and not blank
    digest = F.sha2(F.concat(F.length("x.roles").cast("string"), F.lit(":"), "x.roles", "x.texts"), 256)
    first = stored(first.select("conv", "part", "at", digest.alias("digest")), "conversation-rows")
    least = first.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("part").alias("first_part"))
    again = first.join(least, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("part") > F.col("first_part")))
    return again.groupBy(F.col("part").alias("of_part")).agg(F.collect_list("at").alias("late"))


def _merged(parts: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """Whole conversations (conv, facts, paths) from the tables of their parts, and each part's start, end and letters.

    Groups of up to ``fan`` parts become one part, until each conversation is one. Then the states chosen for
    a group are handed down to its members.
    """
    levels, shift = [parts], 0
    while True:
        sizes = levels[-1].groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("n"), F.max("part").alias("last"))
        if len(levels) > 1 and sizes.where("n > 1").isEmpty():
            break
        shift += (fan - 1).bit_length()
        grouped = levels[-1].join(sizes, F.col("conv").eqNullSafe(F.col("c"))).groupBy(
            "conv", F.when(F.col("n") > fan, F.shiftright("part", shift)).otherwise(0).alias("group")
        )
        members = F.sort_array(F.collect_list(F.struct("part", "facts", "paths"))).alias("members")
        made = grouped.agg(members).withColumn("e", F.arrow_udf(_joined, _TABLED)("members"))
        made = made.select(
            "conv", F.element_at("members.part", 1).alias("part"), F.col("members.part").alias("of"), "e.facts", "e.paths"
        )
        levels.append(stored(made, "conversation-groups"))
    ends = F.array(*(F.struct(F.col("paths")[e]["cost"].alias("cost"), F.col("paths")[e]["letters"].alias("letters"), F.lit(e).alias("end")) for e in ACCEPTED))
    best = F.array_min(F.filter(ends, lambda x: x["cost"].isNotNull()))
    top = levels[-1].withColumn("best", best)
    whole = top.select("conv", "facts", "best.cost", "best.letters")
    chosen = top.select("of", F.col("paths")[F.col("best.end")]["states"].alias("states"))
    for level in reversed(levels[:-1]):
        below = chosen.select("states", F.posexplode("of").alias("i", "of_part")).select(
            "of_part",
            F.substring("states", F.col("i") + 1, F.lit(1)).cast("int").alias("start"),
            F.substring("states", F.col("i") + 2, F.lit(1)).cast("int").alias("end"),
        )
        path = F.col("paths")[F.col("start") * STATES + F.col("end")]
        kept = ["of"] if "of" in level.columns else []
        told = level.join(below, F.col("part") == F.col("of_part"))
        chosen = told.select("part", "start", *kept, path["letters"].alias("letters"), path["states"].alias("states"))
    return whole, chosen


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    part_rows: int = PART_ROWS, fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """What was found and done per conversation, and the repaired conversations.

    The first table has ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and
    ``audit``. The second one has ``conv_id``, ``part`` (in order), ``only`` (whether it is the conversation's only
    part) and ``rows``, an array of role and text.
    """
    named = rows.select(
        F.col(conv).cast("string").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    parts = _parts(named, part_rows)
    # few conversations are in several parts; one that only shares their hash may be joined as well
    split = parts.groupBy("conv").count().where("count > 1").select(F.xxhash64("conv").alias("split")).distinct()
    split = small(stored(split, "conversation-split"))
    same = F.xxhash64("conv") == F.col("split")
    single = parts.join(split, same, "left_anti").withColumn("e", F.arrow_udf(_solved, _SOLVED)("turns", "roles", "texts", "codes"))
    several = parts.join(split, same, "left_semi")
    late = _late(several)
    tabled = several.join(late, F.col("part") == F.col("of_part"), "left").withColumn("e", F.arrow_udf(_tabled, _TABLED)("turns", "roles", "codes", "late"))
    whole, chosen = _merged(stored(tabled.select("conv", "part", "e.facts", "e.paths"), "conversation-tables"), fan)
    chosen = chosen.select(F.col("part").alias("of_part"), "start", "letters")

    kind = rows.schema[conv].dataType
    report = single.select("conv", "e.facts", "e.cost", "e.letters").unionByName(whole)
    span = F.col("facts.last_turn").cast("decimal(20,0)") - F.col("facts.first_turn").cast("decimal(20,0)") + 1 - F.col("facts.turns")
    report = report.select(
        F.col("conv").cast(kind).alias("conv_id"),
        F.least(F.coalesce(span, F.lit(0)), F.lit(2**63 - 1)).cast("long").alias("gaps"),
        *(f"facts.{name}" for name in ("blank", "duplicate", "truncated", "illegal")),
        "cost",
        F.col("letters").alias("audit"),
    )
    pieces = several.join(chosen, F.col("part") == F.col("of_part")).select(
        "conv", "part", F.lit(False).alias("only"), F.arrow_udf(_edited, _ROWS)("start", "letters", "roles", "texts").alias("rows")
    )
    repaired = single.select("conv", "part", F.lit(True).alias("only"), "e.rows").unionByName(pieces)
    return report, repaired.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", "conv_id")


def lines(rows: Column) -> Column:
    """``role:text`` of each row, joined by newlines; null without rows."""
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id`` and ``sha256`` of the repaired conversations' lines.

    A conversation in several parts is hashed part by part as they come in order, and never held as a whole.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv", pa.string()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        begun, conv, running, empty = False, None, hashlib.sha256(), True
        for batch in batches:
            done = []
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not begun or own != conv:
                    if begun:
                        done.append({"conv": conv, "sha256": running.hexdigest()})
                    begun, conv, running, empty = True, own, hashlib.sha256(), True
                if body.is_valid:
                    running.update(b"" if empty else b"\n")
                    running.update(body.as_buffer())
                    empty = False
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": running.hexdigest()}], schema=schema)

    whole = repaired.where("only").select("conv_id", F.sha2(F.coalesce(lines(F.col("rows")), F.lit("")), 256).alias("sha256"))
    parts = repaired.where("not only").select(F.col("conv_id").cast("string").alias("conv"), "part", lines(F.col("rows")).alias("body"))
    streamed = parts.repartition("conv").sortWithinPartitions("conv", "part").select("conv", "body").mapInArrow(run, "conv string, sha256 string")
    return whole.unionByName(streamed.select(F.col("conv").cast(kind).alias("conv_id"), "sha256"))
