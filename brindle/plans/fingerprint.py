"""Statement fingerprints: one pattern for all statements of a shape, whatever their literals."""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import tokens

#: FNV-1a of 64 bits, and the tags that enter it.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
SHAPE_TAGS = {"word": 1, "keyword": 1, "int": 2, "num": 2, "str": 2, "param": 2, "named": 2, "null": 3, "(": 4, ")": 5, ",": 6, "*": 7, "=": 8, "!=": 9, "<": 10, "<=": 11, ">": 12, ">=": 13, ".": 14}
ARG_TAGS = {"int": 1, "num": 2, "str": 2}
HEADS = ("select", "insert", "update")


@dataclass(frozen=True)
class Fingerprint:
    pattern_id: int
    arg_hash: int
    param_count: int


def fnv(data: bytes, state: int = OFFSET) -> int:
    for b in data:
        state = ((state ^ b) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return state


def _field(text: str, fold: bool) -> bytes:
    data = text.encode()
    if fold:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return (len(data) & 0xFFFF).to_bytes(2, "little") + data


def fingerprint(sql: str) -> Fingerprint | None:
    """The fingerprint of a SELECT, INSERT or UPDATE; None for other heads and text that doesn't lex.

    Names are folded to lower case, every literal and parameter is one mark in
    the shape, semicolons don't count, and neither do groups of VALUES after the first.
    """
    found = tokens(sql)
    if found[0].text.lower() not in HEADS or any(t.kind == "bad" for t in found):
        return None
    shape, args, params, groups, depth, in_values = OFFSET, OFFSET, 0, 0, 0, False
    for t in found[:-1]:
        if t.is_(";"):
            continue
        if in_values:
            depth += t.is_("(") - t.is_(")")
            groups += t.is_("(") and depth == 1
        # past the first group, the comma before a group included, only arguments count
        later = in_values and (groups > 1 or (groups == 1 and depth == 0 and not t.is_(")")))
        in_values = in_values or (t.is_("values") and found[0].is_("insert"))
        tag = SHAPE_TAGS[t.text if t.kind == "op" else t.kind]
        if not later:
            shape = fnv(bytes([tag]), shape)
            if tag == 1:
                shape = fnv(_field(t.text, True), shape)
        if t.kind in ARG_TAGS:
            args = fnv(bytes([ARG_TAGS[t.kind]]) + _field(t.text, False), args)
        params += t.kind in ("param", "named")
    return Fingerprint(shape, args, params)
