"""Regular expressions of the ECMAScript dialect, as Java ones."""

from __future__ import annotations

import re

from ravelin.errors import bad

# What ECMAScript's \s matches, and its line terminators.
SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_LINE_END = r"[^\n\r\u2028\u2029]"


def to_java(pattern: str) -> str:
    """The same matches under Java: ``$`` only at the very end, ``.`` and ``\\s`` as ECMAScript has them."""
    out: list[str] = []
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise bad("the pattern ends in a backslash")
            e = pattern[i + 1]
            i += 2
            if e in "sS":
                if in_class:
                    if e == "S":
                        out.append(rf"&&[^{SPACE}]" if out[-1] == "[" else rf"[^{SPACE}]")
                    else:
                        out.append(SPACE)
                else:
                    out.append(f"[{'^' if e == 'S' else ''}{SPACE}]")
            elif e == "u" and i < len(pattern) and pattern[i] == "{":
                end = pattern.find("}", i)
                out.append(rf"\x{{{pattern[i + 1 : end]}}}")
                i = end + 1
            elif e == "c":
                out.append(rf"\c{pattern[i].upper()}")
                i += 1
            elif e == "v":
                out.append(r"\x0B")
            elif e == "0":
                out.append(r"\x00")
            elif e == "/":
                out.append("/")
            elif e == "-":
                out.append(r"\-")
            else:
                out.append("\\" + e)
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c in "[&~":
                c = "\\" + c
        elif c == "[":
            in_class = True
            if pattern.startswith("[]", i):  # matches nothing
                out.append(r"(?!)")
                i, in_class = i + 2, False
                continue
            if pattern.startswith("[^]", i):  # matches anything
                out.append(r"(?s:.)")
                i, in_class = i + 3, False
                continue
            if pattern.startswith("[^", i):
                out.append("[^")
                i += 2
                continue
        elif c == "$":
            c = r"\z"
        elif c == ".":
            c = NOT_LINE_END
        out.append(c)
        i += 1
    if in_class:
        raise bad("a character class is not closed")
    text = "".join(out)
    check = text.replace(r"\z", r"\Z").replace(r"\x{", r"\x7b")
    try:
        re.compile(re.sub(r"\(\?<([a-zA-Z]\w*)>", r"(?P<\1>", check))
    except re.error as e:
        raise bad(f"bad pattern: {e}") from None
    return text


def like_to_java(pattern: str) -> str:
    """``*`` any run, ``?`` any one character (a CR LF counts as one), line breaks included."""
    out = []
    for c in pattern:
        out.append(".*" if c == "*" else r"(?:\r\n|.)" if c == "?" else re.escape(c))
    return f"(?s)^{''.join(out)}\\z"
