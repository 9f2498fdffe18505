"""Tokens of the dialect, each with its byte position."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The reserved words; all others can name columns and tables.
RESERVED = frozenset("join on as in exists not between left right full outer".split())

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)
    |(?P<num>-?[0-9]+\.[0-9]+)
    |(?P<int>-?[0-9]+)
    |(?P<str>'[^']*(?:'|\Z))
    |(?P<named>\$[A-Za-z_][A-Za-z0-9_]*)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>!=|<=|>=|[=<>(),*.;?])
    |(?P<bad>.)""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    """kind: word, keyword, null, int, num, str, param, named, op, bad or end; ``text`` as written, a string without its quotes."""

    kind: str
    text: str
    byte: int

    def is_(self, *texts: str) -> bool:
        return self.kind in ("word", "keyword", "op", "null") and self.text.lower() in texts


def tokens(sql: str) -> list[Token]:
    out, byte = [], 0
    for m in _TOKEN.finditer(sql):
        kind, text = m.lastgroup, m.group()
        if kind == "word":
            low = text.lower()
            kind = "null" if low == "null" else "keyword" if low in RESERVED else "word"
        if kind == "op" and text == "?":
            kind = "param"
        if kind == "str":
            text = text[1:].removesuffix("'")
        if kind != "skip":
            out.append(Token(kind, text, byte))
        byte += len(m.group().encode())
    return [*out, Token("end", "", byte)]
