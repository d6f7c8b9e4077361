"""Recursive-descent parsers for expressions, options, $apply, $search and resource paths."""

from __future__ import annotations

import re
from decimal import Decimal
from urllib.parse import unquote

from ravelin.errors import bad, unsupported
from ravelin.plans.tokens import Token, tokens
from ravelin.plans.tree import (
    AggregateItem, Aggregated, Alias, Binary, Call, Computed, Counted, Expansion, Items, Literal, Node, Options, Order, Path, PRECEDENCE, Quantified, Request, Search, Segment, Step, Term, Unary,
)

DEEPEST = 100
LEVELS = [("or",), ("and",), ("eq", "ne"), ("gt", "ge", "lt", "le", "has", "in"), ("add", "sub"), ("mul", "div", "divby", "mod")]
TRANSFORMATIONS = frozenset("identity aggregate groupby filter search compute orderby top skip topcount topsum toppercent bottomcount bottomsum bottompercent concat join outerjoin expand ancestors descendants traverse".split())


class Parser:
    """A cursor over the tokens of one text."""

    def __init__(self, text: str):
        self.text, self.list, self.at, self.depth = text, tokens(text), 0, 0

    # --- cursor ---

    @property
    def now(self) -> Token:
        return self.list[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.list[min(self.at + n, len(self.list) - 1)]

    def take(self) -> Token:
        self.at += 1
        return self.list[self.at - 1]

    def accept(self, text: str) -> bool:
        if self.now.text == text and self.now.kind in ("mark", "name"):
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise bad(f"expected {text!r} at {self.now.at}, found {self.now.text!r} in {self.text!r}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise bad(f"expected a name at {self.now.at} in {self.text!r}")
        return self.take().text

    def finish(self) -> None:
        if self.now.kind != "end":
            raise bad(f"unexpected {self.now.text!r} at {self.now.at} in {self.text!r}")

    # --- expressions ---

    def expression(self, level: int = 0) -> Node:
        self.depth += 1
        if self.depth > DEEPEST * 8:
            raise bad("the expression is nested too deeply")
        try:
            if level == len(LEVELS):
                return self.unary()
            left = self.expression(level + 1)
            while self.now.kind == "name" and self.now.text in LEVELS[level]:
                op = self.take().text
                left = Binary(op, left, self.expression(level + 1))
            return left
        finally:
            self.depth -= 1

    def unary(self) -> Node:
        if self.now.kind == "name" and self.now.text == "not" and self.peek().text not in ("/", ",", ")"):
            self.take()
            return Unary("not", self.unary())
        if self.now.text == "-" and self.now.kind == "mark":
            self.take()
            if self.now.text == "INF":
                self.take()
                return Literal(float("-inf"), "double")
            return Unary("-", self.unary())
        return self.primary()

    def primary(self) -> Node:
        t = self.now
        if t.text == "(" and t.kind == "mark":
            self.take()
            first = self.expression()
            if self.accept(","):
                items = [first, self.expression()]
                while self.accept(","):
                    items.append(self.expression())
                self.expect(")")
                return Items(tuple(items))
            self.expect(")")
            return Items((first,)) if self.list[self.at - 1] and self._after_in(t) else first
        literal = self.literal()
        if literal is not None:
            return literal
        if t.kind == "name":
            return self.member()
        raise bad(f"unexpected {t.text!r} at {t.at} in {self.text!r}")

    def _after_in(self, opening: Token) -> bool:
        k = next(i for i, x in enumerate(self.list) if x is opening)
        return k > 0 and self.list[k - 1].text == "in" and self.list[k - 1].kind == "name"

    def literal(self) -> Literal | None:
        t = self.now
        match t.kind:
            case "string":
                self.take()
                return Literal(t.text[1:-1].replace("''", "'"), "string")
            case "number":
                self.take()
                if "e" in t.text.lower():
                    return Literal(float(t.text), "double")
                return Literal(Decimal(t.text), "decimal") if "." in t.text else Literal(int(t.text), "int")
            case "guid":
                self.take()
                return Literal(t.text.lower(), "guid")
            case "date" | "datetime" | "time":
                self.take()
                return Literal(t.text, t.kind)
            case "prefixed":
                self.take()
                kind, _, rest = t.text.partition("'")
                if kind.startswith("geo"):
                    raise unsupported("geospatial values are not supported")
                return Literal(rest[:-1], kind)
            case "name":
                if t.text in ("null", "true", "false", "INF", "NaN"):
                    self.take()
                    if t.text == "null":
                        return Literal(None, "null")
                    return Literal(t.text == "true", "bool") if t.text in ("true", "false") else Literal(float(t.text.lower()), "double")
                if self.peek().kind == "string" and self.peek().at == t.at + len(t.text):
                    self.take()
                    return Literal((t.text, self.take().text[1:-1]), "enum")
        return None

    def member(self) -> Node:
        """A path, function call, lambda, count or aggregate."""
        first = self.take().text
        if first.startswith("@"):
            return Alias(first)
        if self.now.text == "(" and self.now.kind == "mark":
            return self.call(first)
        segments = [first]
        while self.accept("/"):
            name = self.name()
            if name in ("any", "all") and self.now.text == "(":
                return self.quantified(Path(tuple(segments)), name)
            if name == "$count":
                return self.counted(Path(tuple(segments)))
            if name == "aggregate" and self.now.text == "(":
                self.expect("(")
                item = self.aggregate_item(named=False)
                self.expect(")")
                return Aggregated(Path(tuple(segments)), item)
            if self.now.text == "(" and self.now.kind == "mark":
                raise unsupported(f"a call of {name} on a path")
            segments.append(name)
        return Path(tuple(segments))

    def call(self, name: str) -> Node:
        self.expect("(")
        arguments, named = [], []
        while not self.accept(")"):
            if arguments or named:
                self.expect(",")
            if self.now.kind == "name" and self.peek().text == "=":
                key = self.take().text
                self.take()
                named.append((key, self.expression()))
            else:
                arguments.append(self.expression())
        return Call(name, tuple(arguments), tuple(named))

    def quantified(self, path: Path, kind: str) -> Quantified:
        self.expect("(")
        if self.accept(")"):
            if kind == "all":
                raise bad("all() needs a condition")
            return Quantified(path, kind, None, None)
        variable = self.name()
        self.expect(":")
        body = self.expression()
        self.expect(")")
        return Quantified(path, kind, variable, body)

    def counted(self, path: Path) -> Counted:
        found = None
        if self.now.text == "(" and self.peek().text in ("$filter", "$search"):
            self.take()
            if self.take().text == "$search":
                raise unsupported("$search in a count")
            self.expect("=")
            found = self.expression()
            self.expect(")")
        return Counted(path, found)

    # --- lists ---

    def orders(self) -> tuple[Order, ...]:
        out = []
        while True:
            e = self.expression()
            down = self.accept("desc")
            if not down:
                self.accept("asc")
            out.append(Order(e, down))
            if not self.accept(","):
                return tuple(out)

    def computes(self) -> tuple[Computed, ...]:
        out = []
        while True:
            e = self.expression()
            self.expect("as")
            out.append(Computed(e, self.name()))
            if not self.accept(","):
                return tuple(out)

    def aggregate_item(self, named: bool = True) -> AggregateItem:
        if self.accept("$count"):
            expression, method = None, None
        else:
            expression, method = self.expression(), None
            if isinstance(expression, Path) and expression.segments[-1] == "$count":
                expression = Counted(Path(expression.segments[:-1]))
            if self.accept("with"):
                method = self.name()
        if self.accept("from"):
            raise unsupported("from in aggregate")
        alias = self.name() if self.accept("as") else ""
        if named and not alias:
            if method or not isinstance(expression, Path):
                raise bad("an aggregate needs an alias")
            alias = expression.segments[-1]
        return AggregateItem(expression, method, alias)

    def aggregates(self) -> tuple[AggregateItem, ...]:
        out = [self.aggregate_item()]
        while self.accept(","):
            out.append(self.aggregate_item())
        return tuple(out)

    # --- $apply ---

    def sequence(self) -> tuple[Step, ...]:
        out = [self.step()]
        while self.accept("/"):
            out.append(self.step())
        return tuple(out)

    def whole(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            raise bad(f"expected a whole number at {self.now.at} in {self.text!r}")
        return int(self.take().text)

    def step(self) -> Step:
        kind = self.name()
        if kind == "identity":
            return Step("identity")
        if kind in ("nest",):
            raise unsupported(f"the transformation {kind}")
        if kind not in TRANSFORMATIONS:
            raise bad(f"unknown transformation {kind}")
        self.expect("(")
        match kind:
            case "aggregate":
                args: tuple = (self.aggregates(),)
            case "groupby":
                args = self.groupby()
            case "filter":
                args = (self.expression(),)
            case "compute":
                args = (self.computes(),)
            case "orderby":
                args = (self.orders(),)
            case "top" | "skip":
                args = (self.whole(),)
            case "topcount" | "topsum" | "toppercent" | "bottomcount" | "bottomsum" | "bottompercent":
                n = self.expression()
                self.expect(",")
                args = (n, self.expression())
            case "concat":
                parts = [self.sequence()]
                while self.accept(","):
                    parts.append(self.sequence())
                if len(parts) < 2:
                    raise bad("concat needs two sequences at least")
                args = (tuple(parts),)
            case "join" | "outerjoin":
                nav = self.name()
                self.expect("as")
                alias = self.name()
                args = (nav, alias, self.sequence() if self.accept(",") else ())
            case "expand":
                nav = self.name()
                args = (nav, self.sequence() if self.accept(",") else ())
            case "search":
                begin, depth = self.now.at, 1
                while depth:
                    t = self.take()
                    if t.kind == "end":
                        raise bad("search is not closed")
                    depth += (t.text == "(") - (t.text == ")")
                args = (parse_search(self.text[begin : self.list[self.at - 1].at]),)
                return Step(kind, args)
            case _:
                args = self.hierarchy(kind)
        self.expect(")")
        return Step(kind, args)

    def groupby(self) -> tuple:
        self.expect("(")
        keys = []
        while True:
            if self.now.text in ("rollup", "$all") and self.peek().text in ("(", ",", ")"):
                raise unsupported("rollup in groupby")
            segments = [self.name()]
            while self.accept("/"):
                segments.append(self.name())
            keys.append(Path(tuple(segments)))
            if not self.accept(","):
                break
        self.expect(")")
        return tuple(keys), self.sequence() if self.accept(",") else ()

    def hierarchy(self, kind: str) -> tuple:
        self.expect("$root")
        self.expect("/")
        root = self.name()
        self.expect(",")
        qualifier = self.name()
        self.expect(",")
        node = [self.name()]
        while self.accept("/"):
            node.append(self.name())
        node = Path(tuple(node))
        self.expect(",")
        if kind == "traverse":
            order = self.name()
            if order not in ("preorder", "postorder"):
                raise bad(f"unknown order {order}")
            orders = self.orders() if self.accept(",") else ()
            return root, qualifier, node, order, orders
        if self.now.text in TRANSFORMATIONS and (self.peek().text == "(" or self.now.text == "identity"):
            start = self.sequence()
        else:
            start = (Step("filter", (self.expression(),)),)
        depth, keep = None, False
        while self.accept(","):
            if self.now.kind == "number":
                depth = self.whole()
            else:
                self.expect("keep")
                self.expect("start")
                keep = True
        return root, qualifier, node, start, depth, keep


# --- $search ---

_SEARCH = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|([()])|([^\s()"]+))')


def parse_search(text: str) -> Term | Search:
    """``a b`` is AND; NOT binds tightest, then AND, then OR."""
    words: list[tuple[str, str]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _SEARCH.match(text, at)
        if not m:
            raise bad(f"bad search text at {at}")
        if m[1] is not None:
            words.append(("phrase", re.sub(r"\\(.)", r"\1", m[1])))
        elif m[2]:
            words.append(("mark", m[2]))
        else:
            words.append(("op" if m[3] in ("AND", "OR", "NOT") else "word", m[3]))
        at = m.end()
    place = 0

    def either() -> Term | Search:
        nonlocal place
        parts = [both()]
        while place < len(words) and words[place] == ("op", "OR"):
            place += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Search("OR", tuple(parts))

    def both() -> Term | Search:
        nonlocal place
        parts = [one()]
        while place < len(words) and words[place] not in (("op", "OR"), ("mark", ")")):
            if words[place] == ("op", "AND"):
                place += 1
            parts.append(one())
        return parts[0] if len(parts) == 1 else Search("AND", tuple(parts))

    def one() -> Term | Search:
        nonlocal place
        if place >= len(words):
            raise bad("the search text ends too early")
        kind, word = words[place]
        place += 1
        if (kind, word) == ("op", "NOT"):
            return Search("NOT", (one(),))
        if (kind, word) == ("mark", "("):
            inner = either()
            if place >= len(words) or words[place] != ("mark", ")"):
                raise bad("a parenthesis is not closed in the search text")
            place += 1
            return inner
        if kind in ("op", "mark"):
            raise bad(f"unexpected {word} in the search text")
        return Term(word, kind == "phrase")

    found = either()
    if place < len(words):
        raise bad(f"unexpected {words[place][1]} in the search text")
    return found


# --- options ---


def parse_expression(text: str) -> Node:
    p = Parser(text)
    e = p.expression()
    p.finish()
    return e


def parse_apply(text: str) -> tuple[Step, ...]:
    p = Parser(text)
    s = p.sequence()
    p.finish()
    return s


def split_top(text: str, separator: str) -> list[str]:
    """Parts between separators that stand outside of parentheses and quotes."""
    out, depth, quoted, begin = [], 0, "", 0
    for i, ch in enumerate(text):
        if quoted:
            quoted = "" if ch == quoted else quoted
        elif ch in "'\"":
            quoted = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == separator and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def _whole(name: str, text: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise bad(f"{name} must be a whole number")
    return int(text)


def _literal(name: str, text: str) -> Literal:
    e = parse_expression(text)
    if not isinstance(e, Literal):
        raise bad(f"{name} must be a literal")
    return e


def parse_options(text: str, separator: str = "&") -> Options:
    found: dict = {}
    aliases = []
    for part in split_top(text, separator) if text else []:
        if not part.strip():
            continue
        name, eq, value = part.strip().partition("=")
        if not eq:
            raise bad(f"an option without a value: {part}")
        if name.startswith("@"):
            aliases.append((name, parse_expression(value)))
            continue
        name = name if name.startswith("$") else f"${name}"
        key = {"$from": "from_", "$toInclusive": "to_inclusive"}.get(name, name[1:])
        if key in found:
            raise bad(f"{name} is given twice")
        p = None
        match name:
            case "$filter":
                found[key] = parse_expression(value)
            case "$orderby":
                p = Parser(value)
                found[key] = p.orders()
            case "$compute":
                p = Parser(value)
                found[key] = p.computes()
            case "$select":
                found[key] = tuple(x.strip() for x in split_top(value, ","))
            case "$expand":
                found[key] = tuple(parse_expansion(x.strip()) for x in split_top(value, ","))
            case "$search":
                found[key] = parse_search(value)
            case "$top" | "$skip":
                found[key] = _whole(name, value)
            case "$count":
                if value not in ("true", "false"):
                    raise bad("$count must be true or false")
                found[key] = value == "true"
            case "$apply":
                found[key] = parse_apply(value)
            case "$levels":
                found[key] = "max" if value == "max" else _whole(name, value)
            case "$skiptoken":
                found[key] = value
            case "$at" | "$from" | "$to" | "$toInclusive":
                found[key] = _literal(name, value)
            case "$index":
                raise unsupported("$index")
            case "$format" | "$schemaversion":
                pass
            case _:
                raise bad(f"unknown option {name}")
        if p is not None:
            p.finish()
    return Options(**found, aliases=tuple(aliases))


def parse_expansion(text: str) -> Expansion:
    m = re.fullmatch(r"([^()]+?)(?:\((.*)\))?", text, re.S)
    if not m:
        raise bad(f"bad expansion {text!r}")
    path, suffix = m[1].strip(), None
    for s in ("$count", "$ref"):
        if path.endswith("/" + s):
            path, suffix = path[: -len(s) - 1], s
    return Expansion(path, parse_options(m[2] or "", ";"), suffix)


# --- resource paths ---


def parse_segment(text: str) -> Segment:
    if text.startswith("$filter(") and text.endswith(")"):
        return Segment("$filter", filter=parse_expression(text[8:-1]))
    m = re.fullmatch(r"([^()]+)(?:\((.*)\))?", text, re.S)
    if not m:
        raise bad(f"bad path segment {text!r}")
    if m[2] is None:
        return Segment(m[1])
    keys = []
    for part in split_top(m[2], ",") if m[2].strip() else []:
        k = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.*)", part, re.S)
        keys.append((k[1], parse_expression(k[2])) if k else ("", parse_expression(part)))
    return Segment(m[1], tuple(keys))


def parse_request(url: str) -> Request:
    """``Set(1)/Nav?$filter=...``; percent escapes are decoded part by part."""
    if len(url) > 8192:
        raise bad("the URL is too long")
    path, _, query = url.partition("?")
    segments = tuple(parse_segment(unquote(s)) for s in split_top(path.strip("/"), "/") if s)
    escaped = "%" in query
    return Request(segments, parse_options("&".join(unquote(p) if escaped else p for p in split_top(query, "&")) if query else ""))


__all__ = ["PRECEDENCE", "Parser", "parse_apply", "parse_expansion", "parse_expression", "parse_options", "parse_request", "parse_search", "split_top"]
