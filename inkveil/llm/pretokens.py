"""Cutting text into pre-tokens as the tiktoken library does, and encoding single pre-tokens.

The pattern runs in the module ``regex``. The two libraries know different Unicode versions, so letters and
digits that only one of them knows are looked up once per process by asking tiktoken itself.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata

#: No code point below this one is classed differently.
FIRST_NEW = "͸"
_HIGH = re.compile(f"[{FIRST_NEW}-\U0010ffff]")


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ids, from the contents of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@functools.lru_cache(maxsize=2)
def encoder(data: bytes, pattern: str):
    """The function from the bytes of one pre-token to its ids."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})
    return encoding._core_bpe.encode_single_piece


@functools.lru_cache(maxsize=2)
def token_bytes(data: bytes) -> list[bytes]:
    """Token bytes in the order of their ids; ids that are free have none."""
    ranks = ranks_of(data)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@functools.lru_cache(maxsize=1)
def _newer() -> tuple[str, str]:
    """Letters and digits of ``regex`` that are neither to tiktoken, in this order."""
    import regex
    import tiktoken

    everything = "".join(map(chr, [*range(ord(FIRST_NEW), 0xD800), *range(0xE000, 0x110000)]))
    out = []
    for kind, probe in (("L", "a"), ("N", "1")):
        doubtful = [c for c in regex.findall(rf"\p{{{kind}}}", everything) if unicodedata.category(c) == "Cn"]
        ranks = {bytes([i]): i for i in range(256)}
        for c in doubtful:
            ranks.setdefault((probe + c).encode("utf-8"), len(ranks))
        one = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={})
        out.append("".join(c for c in doubtful if len(one.encode_ordinary(probe + c)) > 1))
    return out[0], out[1]


def _ranges(chars: str) -> str:
    parts, start, last = [], None, None
    for code in [*sorted(map(ord, chars)), None]:
        if start is not None and code != last + 1:
            parts.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        if start is None:
            start = code
        last = code
    return "".join(parts)


@functools.lru_cache(maxsize=2)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


@functools.lru_cache(maxsize=2)
def _careful(pattern: str):
    """The pattern with the classes of tiktoken, and a search for the characters that need it."""
    import regex

    letters, digits = map(_ranges, _newer())
    if not letters and not digits:
        return None, None
    for kind, newer in (("L", letters), ("N", digits)):
        if newer:
            inside = rf"[\p{{{kind}}}--[{newer}]]"
            pattern = re.sub(rf"(\[[^\]]*)\\p\{{{kind}\}}", lambda m, i=inside: m[1] + "\0" + kind, pattern)
            pattern = pattern.replace(rf"\p{{{kind}}}", inside).replace("\0" + kind, rf"\p{{{kind}}}")
    # inside a negated class the newer characters belong to what the class takes
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{letters}{digits}]]")
    return regex.compile(pattern, regex.V1), regex.compile(f"[{letters}{digits}]")


def splitter(text: str, pattern: str):
    """The compiled pattern for this text."""
    if not text.isascii() and _HIGH.search(text):
        careful, needed = _careful(pattern)
        if needed is not None and needed.search(text):
            return careful
    return _compiled(pattern)


def split(text: str, pattern: str) -> list[str]:
    """The pre-tokens of a text, in order; together they are the text."""
    return splitter(text, pattern).findall(text)
