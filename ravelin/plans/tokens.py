"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ravelin.errors import bad

_PATTERNS = [
    ("space", r"\s+"),
    ("string", r"'(?:[^']|'')*'"),
    ("guid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![\w-])"),
    ("datetime", r"-?\d{4,}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d{1,12})?)?(?:Z|[+-]\d\d:\d\d)?"),
    ("date", r"-?\d{4,}-\d\d-\d\d(?!\d)"),
    ("time", r"\d\d:\d\d(?::\d\d(?:\.\d{1,12})?)?"),
    ("prefixed", r"(?:duration|binary|geography|geometry)'(?:[^']|'')*'"),
    ("number", r"-?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?"),
    ("name", r"[@$]?[A-Za-z_\u00c0-\uffff][\w\u00c0-\uffff]*(?:\.[A-Za-z_\u00c0-\uffff][\w\u00c0-\uffff]*)*"),
    ("mark", r"[()/,:;=*\-]"),
]
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS))


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    """Tokens of a text, spaces left out; ``end`` closes them. A minus after an operand is an own token."""
    out: list[Token] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise bad(f"unexpected character {text[at]!r} at {at}")
        kind, word = m.lastgroup or "", m.group()
        if kind != "space":
            out.append(Token(kind, word, at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
