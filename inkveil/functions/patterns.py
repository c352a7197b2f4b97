"""The ordered pattern registry and the structured recogniser built from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from inkveil.constants import (
    BANK_CARD_REGEX,
    EMAIL_REGEX,
    ID_CARD_REGEX,
    PATTERN_CONFIDENCE,
    PHONE_REGEX,
)
from inkveil.functions import sql as F
from inkveil.functions.arrays import empty
from inkveil.functions.spans import ITEM, as_items, find_spans, merge_items, resolve_items
from inkveil.functions.sql import Expr, expression

# EMAIL_REGEX with the same matches in linear time. A match can only start where a run of
# local-part characters starts, or where the match before it ended; trying every position of
# the run, as the plain form does, is quadratic on a long run without "@".
_EMAIL_LINEAR = EMAIL_REGEX.replace(
    "[a-zA-Z0-9._%+-]+@", r"(?:(?<![a-zA-Z0-9._%+-])|\G)[a-zA-Z0-9._%+-]++@", 1
)


# Eleven digits in a row. With the first digit by itself the search fails sooner on letters.
_ELEVEN_DIGITS = r"\p{Nd}\p{Nd}{10}"


@dataclass(frozen=True)
class Pattern:
    """One data type found by a regular expression.

    ``regex`` is in Java syntax and must not match the empty string. ``needs`` is a cheap
    condition every text with a match fulfils, a regex or a literal; texts failing the
    conditions of all patterns are not searched at all.
    """

    type: str
    regex: str
    needs: str | None = None
    needs_literal: bool = False
    confidence: float = PATTERN_CONFIDENCE

    def possible(self, text: Expr) -> Expr:
        if self.needs is None:
            return F.lit(True)
        return text.contains(self.needs) if self.needs_literal else text.rlike(self.needs)

    def find(self, text: Expr) -> Expr:
        """The matches of this pattern alone, as items."""
        return as_items(find_spans(text, self.regex), self.type, self.confidence)

    def guarded(self, text: Expr) -> Expr:
        """The matches, searched for only in a text that can have one."""
        return F.when(self.possible(text), self.find(text)).otherwise(empty(ITEM))


#: Priority order: a match overlapping one of an earlier pattern is dropped whole.
PATTERNS = [
    Pattern("id_card", ID_CARD_REGEX, _ELEVEN_DIGITS),
    Pattern("bank_card", BANK_CARD_REGEX, _ELEVEN_DIGITS),
    Pattern("phone", PHONE_REGEX, _ELEVEN_DIGITS),
    Pattern("email", _EMAIL_LINEAR, "@", needs_literal=True),
]


@expression
def worth_searching(text: Expr, patterns: list[Pattern] | None = None) -> Expr:
    """Whether any pattern can match; each distinct condition is tested once."""
    distinct = {(p.needs, p.needs_literal): p for p in (PATTERNS if patterns is None else patterns)}
    return reduce(lambda a, b: a | b, [p.possible(text) for p in distinct.values()], F.lit(False))


@expression
def find_type(text: Expr, type_: str, patterns: list[Pattern] | None = None) -> Expr:
    """All matches of one pattern of the registry, without regard to the others."""
    pattern = next(p for p in (PATTERNS if patterns is None else patterns) if p.type == type_)
    return pattern.guarded(text)


@expression
def find_structured(text: Expr, patterns: list[Pattern] | None = None) -> Expr:
    """Items of all patterns in position order, each pattern scanning the whole text."""
    patterns = PATTERNS if patterns is None else patterns
    if not patterns:
        return empty(ITEM)
    items = resolve_items([p.guarded(text) for p in patterns])
    return F.when(worth_searching(text, patterns), items).otherwise(empty(ITEM))


def find_and_merge(text: Expr, others: Expr, patterns: list[Pattern] | None = None) -> Expr:
    """``find_structured`` merged with the items of another recogniser."""
    return merge_items(F.concat(find_structured(text, patterns), others))
