import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest

from inkveil.llm import conversations as C
from inkveil.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_row(rows):
    """Everything about one conversation, the edits by trying all states with whole letter strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        kept = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    ways = {"": (0, "", ())}  # role initials so far, shortened to what matters -> cheapest

    def state(made):
        return made if made in ("", "s") else made[-1]

    def inserted(ways):
        for _ in range(2):
            for s, (cost, audit, out) in list(ways.items()):
                role = "assistant" if s == "u" else "user"
                new = (cost + 2, audit + "I", (*out, f"{role}:"))
                ways[role[0]] = min(new, ways.get(role[0], new))
        return ways

    ways = inserted(ways)
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def add(key, way, after=after):
            after[key] = min(way, after.get(key, way))

        for s, (cost, audit, out) in ways.items():
            add(s, (cost + 3, audit + "D", out))
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                new = "assistant" if s == "u" else "user"
                add(new[0], (cost + 2 + extra, audit + "R", (*out, f"{new}:{text}")))
                if role[:1] == new[0] or (s == "" and role[:1] == "s"):
                    add(role[0], (cost + extra, audit + "K", (*out, f"{role}:{text}")))
        ways = inserted(after)
    cost, audit, out = min(ways[s] for s in ("", "a") if s in ways)
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def plain(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: plain_row(own) for conv, own in groups.items()}


def random_rows(convs, longest, seed):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2", "a:b", "sys\nt"]
    texts = ["Yes.", "No!", "well", "", " \n", None, "Why? ", "a\tb", "é…", "long " * 40 + ".", "x "]
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(1, longest)):
            for _ in range(draw.choice([1, 1, 1, 1, 2, 0])):
                rows.append((conv, draw.choice([turn, turn, turn, None, turn * 3]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.7 else f"t{turn}."))
    return rows


def made(spark, rows, **options):
    extra = "part long, codes string, rows int, late int"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], f"{SCHEMA}, {extra}").repartition(5)
    report, repaired = C.repair(df, **options)
    digests = {r["conv_id"]: r["sha256"] for r in C.digests(repaired).collect()}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return {r["conv_id"]: (*(r[n] for n in names), digests[r["conv_id"]]) for r in report.collect()}


def test_edits_against_plain_search(spark):
    rows = random_rows(150, 9, 1) + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (-1, None, None, None)]
    assert made(spark, rows) == plain(rows)


@pytest.mark.parametrize("part_rows, fan", [(1, 2), (3, 4), (7, 64)])
def test_conversations_in_many_parts(spark, part_rows, fan):
    """Parts of few rows, joined in several rounds, give what whole conversations give."""
    rows = random_rows(12, 30, part_rows)
    assert made(spark, rows, part_rows=part_rows, fan=fan) == plain(rows)


def test_all_short_conversations():
    """Every sequence of up to four kinds of rows: the weights find the least (cost, letters)."""
    kinds = [C.code_of(i, f) for i in ("s", "u", "a", "") for f in (C.FINE, C.TRUNCATED)] + [C.code_of("u", C.BLANK)]
    texts = {C.FINE: "x{}.", C.TRUNCATED: "x{}", C.BLANK: " "}
    for n in range(4):
        for codes in itertools.product(kinds, repeat=n):
            rows = []
            for i, code in enumerate(codes):
                initial, fault = C.decoded(code)
                rows.append((i, initial.strip("-"), texts[fault].format(i)))
            assert C.whole_path("".join(codes)) == plain_row(rows)[5:7]


def test_hot_conversation(spark):
    """One conversation with most rows, a third of them equal, spread over tasks."""
    rows = [(1, i // 3, ["user", "assistant", "user"][i % 3], f"text {i}." if i % 7 else "again.") for i in range(3000)]
    rows += [(1, 5, "user", "same")] * 1500 + [(c, 0, "user", "hi.") for c in range(2, 40)]
    assert made(spark, rows, part_rows=64, fan=8) == plain(rows)


def test_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "?"), (1, 1, "assistant", "y. " * 900_000)]
    assert made(spark, rows) == plain(rows)
    report, repaired = C.repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and C.digests(repaired).count() == 0


def test_query_damages_first(spark, tmp_path):
    import zlib

    rows = random_rows(60, 8, 3) + [(None, None, None, None), (7000, 1, "user", "gone")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    after = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            after += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows} | plain(after)
    found = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {r[0]: tuple(r)[1:] for r in found} == want
