"""The span semantics as conditions, for comparison with the Spark jobs.

Nothing here walks over a text marking what is taken: an item is kept or not by what overlaps it.
"""

import functools

import regex

PATTERNS = [
    ("id_card", r"\p{Nd}{17}[\p{Nd}Xx]"),
    ("bank_card", r"\p{Nd}{16,19}"),
    ("phone", r"1[3-9]\p{Nd}{9}"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
]


def structured(text):
    """A match is kept unless a kept match of a better pattern shares a character with it."""
    matches = [
        [(*m.span(), kind, m.group(), 1.0) for m in regex.finditer(rx, text)] for kind, rx in PATTERNS
    ]

    @functools.cache
    def kept(rank):
        better = [item for other in range(rank) for item in kept(other)]
        return [m for m in matches[rank] if all(b[1] <= m[0] or m[1] <= b[0] for b in better)]

    return sorted(item for rank in range(len(PATTERNS)) for item in kept(rank))


def merge(items):
    """The recurrence over items by (start, end): a state is the settled items and the one still open."""

    def following(state, item):
        settled, last = state
        if last is None or item[0] >= last[1] or item[1] <= last[0]:
            return (settled if last is None else [*settled, last]), item
        stronger = item[4] > last[4] or item[4] == last[4] == 1.0
        return settled, item if stronger else last

    settled, last = functools.reduce(following, sorted(items, key=lambda x: x[:2]), ([], None))
    return settled if last is None else [*settled, last]


def spliced_disjoint(text, edits):
    """The untouched gaps with the new values between them, for edits that do not overlap."""
    order = sorted(edits, key=lambda e: e[0])
    starts = [e[0] for e in order] + [len(text)]
    ends = [0] + [e[1] for e in order]
    gaps = [text[a:b] for a, b in zip(ends, starts)]
    return "".join(part for pair in zip(gaps, [e[2] for e in order] + [""]) for part in pair)
