"""Syntax trees. ``str()`` writes text that parses back to an equal tree."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    """kind: null bool int decimal double string date datetime time duration binary guid enum."""

    value: object
    kind: str

    def __str__(self) -> str:
        match self.kind:
            case "null":
                return "null"
            case "bool":
                return "true" if self.value else "false"
            case "string":
                return "'" + str(self.value).replace("'", "''") + "'"
            case "double" if self.value in (float("inf"), float("-inf")):
                return "INF" if self.value == float("inf") else "-INF"
            case "double" if self.value != self.value:
                return "NaN"
            case "duration" | "binary":
                return f"{self.kind}'{self.value}'"
            case "enum":
                return f"{self.value[0]}'{self.value[1]}'"  # type: ignore[index]
        return str(self.value)


@dataclass(frozen=True)
class Path:
    """Member path; a segment with a dot is a type cast; the first may be $it, $this, $these, $root or a variable."""

    segments: tuple[str, ...]

    def __str__(self) -> str:
        return "/".join(self.segments)


@dataclass(frozen=True)
class Alias:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Node

    def __str__(self) -> str:
        inner = _inside(self.operand, 90)
        return f"not {inner}" if self.op == "not" else f"-{inner}" if not inner.startswith("-") else f"-({inner})"


@dataclass(frozen=True)
class Binary:
    op: str
    left: Node
    right: Node

    def __str__(self) -> str:
        mine = PRECEDENCE[self.op]
        return f"{_inside(self.left, mine)} {self.op} {_inside(self.right, mine + 1)}"


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple[Node, ...] = ()
    named: tuple[tuple[str, Node], ...] = ()

    def __str__(self) -> str:
        parts = [str(a) for a in self.arguments] + [f"{k}={v}" for k, v in self.named]
        return f"{self.name}({','.join(parts)})"


@dataclass(frozen=True)
class Quantified:
    """any/all over the collection at ``path``."""

    path: Path
    kind: str
    variable: str | None
    body: Node | None

    def __str__(self) -> str:
        return f"{self.path}/{self.kind}({f'{self.variable}:{self.body}' if self.body is not None else ''})"


@dataclass(frozen=True)
class Counted:
    path: Path
    filter: Node | None = None

    def __str__(self) -> str:
        return f"{self.path}/$count" + (f"($filter={self.filter})" if self.filter is not None else "")


@dataclass(frozen=True)
class AggregateItem:
    """``expression with method as alias``; ``$count as alias``; ``Custom as alias``."""

    expression: Node | None
    method: str | None
    alias: str

    def __str__(self) -> str:
        what = "$count" if self.expression is None else str(self.expression)
        return what + (f" with {self.method}" if self.method else "") + (f" as {self.alias}" if self.alias else "")


@dataclass(frozen=True)
class Aggregated:
    """``Nav/aggregate(p with sum)`` as a value; ``$these/aggregate(...)``."""

    path: Path
    item: AggregateItem

    def __str__(self) -> str:
        return f"{self.path}/aggregate({self.item})"


@dataclass(frozen=True)
class Items:
    items: tuple[Node, ...]

    def __str__(self) -> str:
        return "(" + ",".join(map(str, self.items)) + ")"


Node = Literal | Path | Alias | Unary | Binary | Call | Quantified | Counted | Aggregated | Items
PRECEDENCE = {"or": 10, "and": 20, "eq": 30, "ne": 30, "gt": 40, "ge": 40, "lt": 40, "le": 40, "has": 40, "in": 40, "add": 50, "sub": 50, "mul": 60, "div": 60, "divby": 60, "mod": 60}


def _inside(node: Node, least: int) -> str:
    own = PRECEDENCE[node.op] if isinstance(node, Binary) else 80 if isinstance(node, Unary) else 100
    return str(node) if own >= least else f"({node})"


@dataclass(frozen=True)
class Order:
    expression: Node
    descending: bool = False

    def __str__(self) -> str:
        return f"{self.expression}{' desc' if self.descending else ''}"


@dataclass(frozen=True)
class Computed:
    expression: Node
    name: str

    def __str__(self) -> str:
        return f"{self.expression} as {self.name}"


@dataclass(frozen=True)
class Term:
    """A leaf of a search expression."""

    text: str
    phrase: bool = False

    def __str__(self) -> str:
        return f'"{self.text}"' if self.phrase else self.text


@dataclass(frozen=True)
class Search:
    op: str  # AND OR NOT
    parts: tuple[Term | Search, ...]

    def __str__(self) -> str:
        inner = [f"({p})" if isinstance(p, Search) and (self.op == "NOT" or p.op == "OR") else str(p) for p in self.parts]
        return f"NOT {inner[0]}" if self.op == "NOT" else f" {self.op} ".join(inner)


@dataclass(frozen=True)
class Step:
    """One transformation of $apply; what ``args`` holds depends on ``kind``."""

    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        join = lambda xs: ",".join(map(str, xs))
        match self.kind:
            case "identity":
                return "identity"
            case "aggregate" | "compute" | "orderby":
                return f"{self.kind}({join(self.args[0])})"
            case "groupby":
                keys, then = self.args
                return f"groupby(({join(keys)}){',' + sequence_text(then) if then else ''})"
            case "concat":
                return f"concat({','.join(sequence_text(s) for s in self.args[0])})"
            case "join" | "outerjoin":
                nav, alias, then = self.args
                return f"{self.kind}({nav} as {alias}{',' + sequence_text(then) if then else ''})"
            case "ancestors" | "descendants":
                h, q, p, start, depth, keep = self.args
                return f"{self.kind}($root/{h},{q},{p},{sequence_text(start)}{f',{depth}' if depth is not None else ''}{',keep start' if keep else ''})"
            case "traverse":
                h, q, p, order, orders = self.args
                return f"traverse($root/{h},{q},{p},{order}{''.join(f',{o}' for o in orders)})"
        return f"{self.kind}({join(a for a in self.args if a is not None)})"


def sequence_text(steps: tuple[Step, ...]) -> str:
    return "/".join(map(str, steps))


@dataclass(frozen=True)
class Expansion:
    path: str  # navigation name, NS.T/Nav or *
    options: Options
    suffix: str | None = None  # $count or $ref

    def __str__(self) -> str:
        return self.path + (f"/{self.suffix}" if self.suffix else "") + (f"({self.options.text(';')})" if self.options != Options() else "")


@dataclass(frozen=True)
class Options:
    """System query options of one request or expansion."""

    filter: Node | None = None
    orderby: tuple[Order, ...] = ()
    select: tuple[str, ...] = ()
    expand: tuple[Expansion, ...] = ()
    compute: tuple[Computed, ...] = ()
    search: Term | Search | None = None
    top: int | None = None
    skip: int | None = None
    count: bool = False
    apply: tuple[Step, ...] = ()
    levels: int | str | None = None
    skiptoken: str | None = None
    at: Literal | None = None
    from_: Literal | None = None
    to: Literal | None = None
    to_inclusive: Literal | None = None
    aliases: tuple[tuple[str, Node], ...] = field(default=())

    def text(self, separator: str = "&") -> str:
        join = lambda xs: ",".join(map(str, xs))
        out = []
        for name, value in (
            ("$apply", sequence_text(self.apply)), ("$at", self.at), ("$from", self.from_), ("$to", self.to), ("$toInclusive", self.to_inclusive), ("$search", self.search), ("$compute", join(self.compute)), ("$filter", self.filter),
            ("$orderby", join(self.orderby)), ("$skiptoken", self.skiptoken), ("$skip", self.skip), ("$top", self.top), ("$count", "true" if self.count else None), ("$levels", self.levels), ("$expand", join(self.expand)), ("$select", join(self.select)),
        ):
            if value is not None and str(value) != "":
                out.append(f"{name}={value}")
        return separator.join([*out, *(f"{k}={v}" for k, v in self.aliases)])

    def __str__(self) -> str:
        return self.text()


@dataclass(frozen=True)
class Segment:
    """One segment of a resource path."""

    name: str
    keys: tuple[tuple[str, Node], ...] | None = None
    filter: Node | None = None


@dataclass(frozen=True)
class Request:
    segments: tuple[Segment, ...]
    options: Options
