"""A fluent builder of requests: the same trees that the parser makes, and their text."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

from ravelin.errors import unsupported
from ravelin.plans.parser import parse_apply, parse_expression, parse_search
from ravelin.plans.tree import Binary, Call, Computed, Counted, Expansion, Items, Literal, Node, Options, Order, Path, Quantified, Step, Unary

NEW_IN_401 = frozenset({"matchesPattern", "divby"})


def value(x: object) -> Node:
    if isinstance(x, Expr):
        return x.node
    if isinstance(x, Literal | Path | Unary | Binary | Call | Quantified | Counted | Items):
        return x
    kinds = {bool: "bool", int: "int", float: "double", str: "string", Decimal: "decimal", type(None): "null"}
    return Literal(x, kinds[type(x)])


class Expr:
    """A node with Python's operators."""

    def __init__(self, node: Node):
        self.node = node

    def _with(self, op: str, other: object) -> Expr:
        return Expr(Binary(op, self.node, value(other)))

    def __eq__(self, other: object) -> Expr:  # type: ignore[override]
        return self._with("eq", other)

    def __ne__(self, other: object) -> Expr:  # type: ignore[override]
        return self._with("ne", other)

    def __gt__(self, other: object) -> Expr:
        return self._with("gt", other)

    def __ge__(self, other: object) -> Expr:
        return self._with("ge", other)

    def __lt__(self, other: object) -> Expr:
        return self._with("lt", other)

    def __le__(self, other: object) -> Expr:
        return self._with("le", other)

    def __and__(self, other: object) -> Expr:
        return self._with("and", other)

    def __or__(self, other: object) -> Expr:
        return self._with("or", other)

    def __invert__(self) -> Expr:
        return Expr(Unary("not", self.node))

    def __add__(self, other: object) -> Expr:
        return self._with("add", other)

    def __sub__(self, other: object) -> Expr:
        return self._with("sub", other)

    def __mul__(self, other: object) -> Expr:
        return self._with("mul", other)

    def __truediv__(self, other: object) -> Expr:
        return self._with("divby", other)

    def __floordiv__(self, other: object) -> Expr:
        return self._with("div", other)

    def __mod__(self, other: object) -> Expr:
        return self._with("mod", other)

    __hash__ = None  # type: ignore[assignment]

    def isin(self, *values: object) -> Expr:
        return Expr(Binary("in", self.node, Items(tuple(value(v) for v in values))))

    def any(self, variable: str | None = None, body: Expr | None = None) -> Expr:
        return Expr(Quantified(self.node, "any", variable, body.node if body is not None else None))  # type: ignore[arg-type]

    def all(self, variable: str, body: Expr) -> Expr:
        return Expr(Quantified(self.node, "all", variable, body.node))  # type: ignore[arg-type]

    def count(self, where: Expr | None = None) -> Expr:
        return Expr(Counted(self.node, where.node if where is not None else None))  # type: ignore[arg-type]

    def call(self, name: str, *more: object) -> Expr:
        return Expr(Call(name, (self.node, *(value(m) for m in more))))

    def text(self, version: str = "4.01") -> str:
        """The expression's text; at 4.0 ``in`` becomes a chain of ``or``, and newer functions are refused."""
        return str(for_version(self.node, version))

    def __str__(self) -> str:
        return str(self.node)


def for_version(node: Node, version: str) -> Node:
    if version != "4.0":
        return node
    match node:
        case Binary("in", a, Items(items)):
            out: Node | None = None
            for i in items:
                one = Binary("eq", a, i)
                out = one if out is None else Binary("or", out, one)
            return out or Literal(False, "bool")
        case Binary(op, a, b):
            if op in NEW_IN_401:
                raise unsupported(f"{op} at 4.0")
            return Binary(op, for_version(a, version), for_version(b, version))
        case Unary(op, a):
            return Unary(op, for_version(a, version))
        case Call(name, args, named):
            if name in NEW_IN_401:
                raise unsupported(f"{name} at 4.0")
            return Call(name, tuple(for_version(a, version) for a in args), named)
        case Quantified(path, kind, v, body) if body is not None:
            return Quantified(path, kind, v, for_version(body, version))
    return node


def field(path: str) -> Expr:
    return Expr(Path(tuple(path.split("/"))))


class Query:
    """``Query('Orders').filter(field('Totalprice') > 5).top(3)``; immutable."""

    def __init__(self, entity_set: str, options: Options = Options()):  # noqa: B008
        self.entity_set, self.options = entity_set, options

    def _next(self, **changes) -> Query:
        return Query(self.entity_set, replace(self.options, **changes))

    def filter(self, condition: Expr | str) -> Query:
        node = parse_expression(condition) if isinstance(condition, str) else condition.node
        return self._next(filter=node if self.options.filter is None else Binary("and", self.options.filter, node))

    def compute(self, **named: Expr) -> Query:
        return self._next(compute=(*self.options.compute, *(Computed(e.node, n) for n, e in named.items())))

    def search(self, text: str) -> Query:
        return self._next(search=parse_search(text))

    def orderby(self, *by: str | Order) -> Query:
        return self._next(orderby=(*self.options.orderby, *(b if isinstance(b, Order) else Order(parse_expression(b.removesuffix(" desc")), b.endswith(" desc")) for b in by)))

    def select(self, *names: str) -> Query:
        return self._next(select=(*self.options.select, *names))

    def expand(self, path: str, inner: Query | None = None) -> Query:
        return self._next(expand=(*self.options.expand, Expansion(path, inner.options if inner else Options())))

    def top(self, n: int) -> Query:
        return self._next(top=n)

    def skip(self, n: int) -> Query:
        return self._next(skip=n)

    def count(self) -> Query:
        return self._next(count=True)

    def apply(self, text: str) -> Query:
        return self._next(apply=(*self.options.apply, *parse_apply(text)))

    def group(self, keys: list[str], having: str | None = None, orderby: str | None = None, offset: int | None = None, limit: int | None = None, **aggregates: str) -> Query:
        """A grouped fetch as $apply steps: HAVING, order, offset and limit follow the grouping."""
        items = ",".join(f"{e} as {n}" for n, e in aggregates.items())
        steps = [f"groupby(({','.join(keys)}){f',aggregate({items})' if items else ''})" if keys else f"aggregate({items})"]
        for kind, text in (("filter", having), ("orderby", orderby), ("skip", offset), ("top", limit)):
            if text is not None:
                steps.append(f"{kind}({text})")
        return self.apply("/".join(steps))

    def steps(self) -> tuple[Step, ...]:
        return self.options.apply

    @property
    def url(self) -> str:
        text = str(self.options)
        return self.entity_set + (f"?{text}" if text else "")
