"""Frames: a DataFrame with the names that expressions may use, and the joins they need.

Compiling an expression gives a Column and, on the way, adds to the frame the
left joins that the expression needs: to-one paths join their target once; each
lambda, count or aggregate over a collection joins one pre-aggregated row for
each owner. Every join is N:1 and outer, so rows are never dropped or repeated.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.errors import QueryError, bad, unsupported
from ravelin.functions.patterns import to_java
from ravelin.functions.scalars import BOOLEAN, FUNCTIONS, UNSUPPORTED
from ravelin.plans.tree import AggregateItem, Aggregated, Alias, Binary, Call, Counted, Items, Literal, Node, Path, Quantified, Unary
from ravelin.sources.model import EntityModel, EntitySet, Nav

_serial = itertools.count()
COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
# Widening casts between numeric types.
WIDER = {
    "Edm.Byte": "smallint", "Edm.SByte": "tinyint", "Edm.Int16": "smallint", "Edm.Int32": "int", "Edm.Int64": "bigint", "Edm.Single": "float", "Edm.Double": "double", "Edm.Decimal": "decimal(38,10)",
}
INTEGERS = ("tinyint", "smallint", "int", "bigint")
_RANK = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "decimal": 4, "float": 5, "double": 6}


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def fresh(stem: str) -> str:
    return f"__{stem}{next(_serial)}"


@dataclass
class Context:
    """What all frames of one request share."""

    spark: SparkSession
    model: EntityModel
    aliases: dict[str, Node] = field(default_factory=dict)
    now: Literal | None = None

    def rows(self, entity_set: EntitySet) -> DataFrame:
        df = entity_set.load(self.spark)
        return df if entity_set.visible is None else df.filter(entity_set.visible(df))


@dataclass
class Frame:
    ctx: Context
    df: DataFrame
    set: EntitySet | None
    shape: list[str]
    places: dict[str, EntitySet] = field(default_factory=dict)  # joined prefix -> its set
    outer: dict[str, Frame | str] = field(default_factory=dict)  # variable -> prefix here
    computed: dict[str, None] = field(default_factory=dict)
    partition: list[str] = field(default_factory=list)  # keys of the group that a pipeline runs in
    these: DataFrame | None = None
    done: dict[str, str] = field(default_factory=dict)
    expansions: list = field(default_factory=list)
    order: list[tuple[Column, bool]] = field(default_factory=list)

    # --- making ---

    @classmethod
    def of(cls, ctx: Context, entity_set: EntitySet, df: DataFrame | None = None) -> Frame:
        df = ctx.rows(entity_set) if df is None else df
        return cls(ctx, df, entity_set, list(df.columns), {"": entity_set})

    def copy(self, **changes) -> Frame:
        base = {k: (list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) else v) for k, v in self.__dict__.items()}
        return Frame(**(base | changes))

    def with_df(self, df: DataFrame) -> Frame:
        return self.copy(df=df)

    # --- paths ---

    def _kind(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def value(self, path: Path) -> Column:
        """The column that a member path names."""
        prefix, segments = self._start(path.segments)
        entity = self.places.get(prefix)
        condition: Column | None = None
        for i, segment in enumerate(segments):
            last = i == len(segments) - 1
            name = f"{prefix}/{segment}" if prefix else segment
            if "." in segment:
                condition = self._is_type(prefix, segment)
                continue
            rest = segments[i:]
            whole = "/".join(([prefix] if prefix else []) + list(rest))
            if whole in self.df.columns:
                return self._typed(whole, condition, entity, rest[0])
            nav = entity.nav(segment) if entity else None
            if nav is not None:
                if nav.many:
                    raise bad(f"{path} goes through the collection {segment}")
                self._join_one(prefix, nav)
                prefix, entity = name, self.places[name]
                if last:
                    return self._key_of(prefix)
                continue
            if name in self.df.columns:
                kind = self._kind(name)
                column = self._typed(name, condition, entity, segment)
                for inner in segments[i + 1 :]:
                    if not isinstance(kind, T.StructType) or inner not in kind.names:
                        raise bad(f"no property {inner} in {path}")
                    column, kind = column.getField(inner), kind[inner].dataType
                return column
            if entity is not None and entity.dynamic and last:
                bag = f"{prefix}/{entity.dynamic}" if prefix else entity.dynamic
                return F.get_json_object(c(bag), f"$.{segment}")
            raise bad(f"no property {segment} in {path}")
        return self._key_of(prefix)

    def _start(self, segments: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
        first = segments[0]
        if first == "$root":
            raise unsupported("$root in an expression")
        if first in self.outer:
            return str(self.outer[first]), segments[1:]
        if first in ("$it", "$this"):
            return "", segments[1:]
        return "", segments

    def _typed(self, name: str, condition: Column | None, entity: EntitySet | None, prop: str) -> Column:
        column = c(name)
        return column if condition is None else F.when(condition, column)

    def _is_type(self, prefix: str, type_name: str) -> Column:
        entity = self.places[prefix]
        types = entity.types_of(type_name)
        if entity.type_column is None:
            return F.lit(True)
        return F.coalesce(c(f"{prefix}/{entity.type_column}" if prefix else entity.type_column).isin(*types), F.lit(False))

    def _key_of(self, prefix: str) -> Column:
        entity = self.places[prefix]
        if not entity.key:
            raise unsupported(f"{entity.name} has no key")
        return c(f"{prefix}/{entity.key[0]}" if prefix else entity.key[0])

    def _join_one(self, prefix: str, nav: Nav) -> None:
        name = f"{prefix}/{nav.name}" if prefix else nav.name
        if name in self.places:
            return
        target = self.ctx.model.set(nav.target)
        rows = self.ctx.rows(target)
        side = rows.select(*[F.col(f"`{x}`").alias(f"{name}/{x}") for x in rows.columns])
        on = [c(f"{prefix}/{a}" if prefix else a) == c(f"{name}/{b}") for a, b in nav.on]
        condition = on[0]
        for x in on[1:]:
            condition &= x
        self.df = self.df.join(side, condition, "left")
        self.places[name] = target

    # --- collections ---

    def collection(self, path: Path) -> tuple[str, EntitySet, Nav, Column | None, str | None]:
        """Owner's prefix and set, the navigation, whether the owner exists, and a type that members must have."""
        prefix, segments = self._start(path.segments)
        cast = None
        if segments and "." in segments[-1]:
            cast, segments = segments[-1], segments[:-1]
        entity = self.places.get(prefix)
        if entity is None:
            raise bad(f"{path} on grouped rows")
        exists: Column | None = None
        for segment in segments[:-1]:
            if "." in segment:
                test = self._is_type(prefix, segment)
                exists = test if exists is None else exists & test
                continue
            nav = entity.nav(segment)
            if nav is None or nav.many:
                raise bad(f"{segment} is no single-valued navigation in {path}")
            self._join_one(prefix, nav)
            prefix = f"{prefix}/{segment}" if prefix else segment
            entity = self.places[prefix]
            exists = self._key_of(prefix).isNotNull() if exists is None else exists & self._key_of(prefix).isNotNull()
        nav = entity.nav(segments[-1]) if segments else None
        if nav is None or not nav.many:
            raise bad(f"{path} is no collection")
        return prefix, entity, nav, exists, cast

    def members(self, nav: Nav, cast: str | None) -> tuple[Frame, list[str]]:
        """Frame of a navigation's members, and the columns in it that meet the owner's local ones."""
        target = self.ctx.model.set(nav.target)
        frame = Frame.of(self.ctx, target)
        if cast is not None:
            frame.df = frame.df.filter(frame._is_type("", cast))
        if nav.bridge is None:
            return frame, [b for _, b in nav.on]
        bridge = nav.bridge(self.ctx.spark)
        names = {x: fresh(f"bridge_{x}_") for _, x in nav.on} | {x: fresh(f"bridge_{x}_") for x, _ in nav.through}
        side = bridge.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()]).distinct()
        condition = F.lit(True)
        for b, remote in nav.through:
            condition &= c(names[b]) == c(remote)
        frame.df = frame.df.join(side, condition, "inner")
        return frame, [names[b] for _, b in nav.on]

    def _local(self, prefix: str, nav: Nav) -> list[str]:
        return [f"{prefix}/{a}" if prefix else a for a, _ in nav.on]

    def gather(self, path: Path, aggregates, variable: str | None = None, bodies: tuple[Node, ...] = ()) -> tuple[dict[str, Column], Column | None]:
        """Joins one row of aggregates over a collection for each owner.

        ``aggregates(member_frame)`` gives named Columns; bodies that mention an
        outer variable bring the owner's columns into the member rows first.
        """
        prefix, entity, nav, exists, cast = self.collection(path)
        frame, remote = self.members(nav, cast)
        local = self._local(prefix, nav)
        correlated = any(_mentions(b, {*self.outer, "$it"}) for b in bodies)
        if variable:
            frame.outer[variable] = ""
        if correlated:
            root = self.set
            if root is None or not root.key:
                raise unsupported("an outer variable on rows without a key")
            mine = [x for x in self.df.columns if not x.startswith("__")]
            tag = fresh("outer")
            side = self.df.select(*[c(x).alias(f"{tag}/{x}") for x in mine])
            condition = F.lit(True)
            for a, b in zip(local, remote, strict=True):
                condition &= c(f"{tag}/{a}") == c(b)
            frame.df = frame.df.join(side, condition, "inner")
            frame.outer |= {k: (f"{tag}/{v}" if v else tag) for k, v in self.outer.items() if k != variable} | {"$it": tag}
            frame.places |= {(f"{tag}/{k}" if k else tag): v for k, v in self.places.items()}
            by = [f"{tag}/{k}" for k in root.key]
            owner = list(root.key)
        else:
            by, owner = remote, local
        made = aggregates(frame)
        names = {k: fresh(k) for k in made}
        keys = [fresh("key") for _ in by]
        side = frame.df.groupBy(*[c(b).alias(k) for b, k in zip(by, keys, strict=True)]).agg(*[v.alias(names[k]) for k, v in made.items()])
        condition = F.lit(True)
        for a, k in zip(owner, keys, strict=True):
            condition &= c(a) == c(k)
        self.df = self.df.join(side, condition, "left").drop(*keys)
        return {k: c(v) for k, v in names.items()}, exists

    # --- expressions ---

    def compile(self, node: Node) -> Column:
        match node:
            case Literal():
                return literal(node)
            case Path():
                return self.value(node)
            case Alias(name):
                return self.compile(self.resolved(name))
            case Unary("not", x):
                return ~self.compile(x)
            case Unary(_, x):
                return -self.compile(x)
            case Binary(op, a, b):
                return self.binary(op, a, b)
            case Call():
                return self.call(node)
            case Quantified():
                return self.quantified(node)
            case Counted(path, where):
                return self.counted(path, where)
            case Aggregated(path, item):
                return self.aggregated(path, item)
            case Items():
                raise bad("a list may only follow in")
        raise bad(f"can't evaluate {node}")

    def condition(self, node: Node) -> Column:
        """``node`` where null counts as false: comparisons stay plain, so that they reach the scan."""
        node = self.plain(node)
        if isinstance(node, Binary) and node.op in ("and", "or"):
            a, b = self.condition(node.left), self.condition(node.right)
            return a & b if node.op == "and" else a | b
        if isinstance(node, Binary) and node.op in COMPARE:
            return self.compare(node.op, self.plain(node.left), self.plain(node.right), kept=True)
        return self.compile(node)

    def resolved(self, name: str, depth: int = 0) -> Node:
        node = self.ctx.aliases.get(name)
        if node is None:
            return Literal(None, "null")
        if depth > 8:
            raise bad(f"the alias {name} refers to itself")
        return self.resolved(node.name, depth + 1) if isinstance(node, Alias) else node

    def plain(self, node: Node) -> Node:
        return self.resolved(node.name) if isinstance(node, Alias) else node

    def binary(self, op: str, a: Node, b: Node) -> Column:
        a, b = self.plain(a), self.plain(b)
        match op:
            case "and":
                return self.compile(a) & self.compile(b)
            case "or":
                return self.compile(a) | self.compile(b)
            case "eq" | "ne" | "gt" | "ge" | "lt" | "le":
                return self.compare(op, a, b)
            case "in":
                return self.within(a, b)
            case "has":
                return self.has(a, b)
        x, y = self.compile(a), self.compile(b)
        return arithmetic(op, x, y, lambda: (self.type_of(x), self.type_of(y)))

    def type_of(self, column: Column) -> str:
        return self.df.select(column.alias("x")).schema["x"].dataType.simpleString()

    def compare(self, op: str, a: Node, b: Node, kept: bool = False) -> Column:
        """A two-valued comparison; with ``kept``, only where it is true matters."""
        if isinstance(a, Literal) and not isinstance(b, Literal):
            a, b = b, a
            op = {"gt": "lt", "lt": "gt", "ge": "le", "le": "ge"}.get(op, op)
        self.check_filterable(a)
        self.check_filterable(b)
        x = self.compile(a)
        if isinstance(b, Literal) and b.kind == "null":
            return x.isNull() if op == "eq" else x.isNotNull() if op == "ne" else F.lit(False)
        if isinstance(a, Path) and self.is_navigation(a):
            raise bad(f"{a} can only be compared with null")
        kind = self.type_of(x)
        y = self.fitted(b, kind)
        other = op == "ne"
        if kept and not other:
            # NaN equals nothing; Spark sorts it above all else, so one side needs a test at most.
            side, of = (y, self.type_of(y)) if op in ("lt", "le") else (x, kind)
            plain = isinstance(b, Literal) and b.value == b.value and op in ("lt", "le", "eq")
            result = COMPARE[op](x, y)
            return result & ~F.isnan(side) if of in ("double", "float") and not plain else result
        return two_valued(op, x, y, (kind, self.type_of(y)))

    def fitted(self, node: Node, kind: str) -> Column:
        """A literal typed by the property that it meets."""
        if not isinstance(node, Literal):
            return self.compile(node)
        if node.kind in ("date", "datetime") and kind in ("timestamp", "timestamp_ntz", "date"):
            return literal(node, kind)
        if node.kind == "enum":
            return self.enum_value(node, kind)
        if node.kind == "guid" and kind == "string":
            return F.lit(str(node.value))
        return literal(node)

    def enum_value(self, node: Literal, kind: str) -> Column:
        name, text = node.value  # type: ignore[misc]
        enum = self.ctx.model.enums.get(name.rpartition(".")[2])
        if enum is None:
            raise bad(f"unknown enumeration {name}")
        if kind == "string":
            return F.lit(text)
        members = dict(enum.members)
        total = 0
        for part in text.split(","):
            part = part.strip()
            if not part.lstrip("-").isdigit() and part not in members:
                raise bad(f"{part} is no member of {name}")
            total |= int(part) if part.lstrip("-").isdigit() else members[part]
        return F.lit(total)

    def is_navigation(self, path: Path) -> bool:
        prefix, segments = self._start(path.segments)
        entity = self.places.get(prefix)
        for s in segments:
            if "." in s:
                continue
            nav = entity.nav(s) if entity else None
            if nav is None:
                return False
            entity = self.ctx.model.set(nav.target)
        return bool(segments)

    def check_filterable(self, node: Node) -> None:
        if isinstance(node, Path) and self.set is not None and node.segments[-1] in self.set.not_filterable:
            raise bad(f"{node} can't be filtered by")

    def within(self, a: Node, b: Node) -> Column:
        if not isinstance(b, Items):
            raise bad("in needs a list")
        if not all(isinstance(x, Literal) for x in b.items):
            raise unsupported("in with other than literals")
        x = self.compile(a)
        return self.among(x, self.type_of(x), b.items)

    def among(self, x: Column, kind: str, items: tuple) -> Column:
        """Two-valued; a null in the list finds nulls, and NaN is found by nothing."""
        values = [self.fitted(i, kind) for i in items if i.kind != "null" and i.value == i.value and not (kind in INTEGERS and i.kind in ("decimal", "double") and i.value % 1 != 0)]
        found = F.coalesce(x.isin(*values), F.lit(False)) if values else F.lit(False)
        return found | x.isNull() if any(i.kind == "null" for i in items) else found

    def has(self, a: Node, b: Node) -> Column:
        if not isinstance(b, Literal) or b.kind not in ("enum", "int"):
            raise bad("has needs an enumeration literal")
        mask = self.enum_value(b, "int") if b.kind == "enum" else F.lit(b.value)
        return self.compile(a).bitwiseAND(mask) == mask

    def call(self, node: Call) -> Column:
        name, args = node.name, node.arguments
        if name in ("isof", "cast"):
            return self.cast(node)
        if name == "isdefined":
            path = args[0]
            if not isinstance(path, Path):
                raise bad("isdefined needs a path")
            if self.set is None:
                return F.lit(str(path) in self.shape)
            try:
                self.copy().value(path)
            except QueryError:  # a path that can't be resolved is not defined
                return F.lit(False)
            return F.lit(True)
        if name == "now":
            return literal(self.ctx.now or Literal("1970-01-01T00:00:00Z", "datetime"), "timestamp_ntz")
        if name == "matchesPattern":
            if len(args) != 2 or not isinstance(args[1], Literal) or args[1].kind != "string":
                raise bad("matchesPattern needs a literal pattern")
            return F.rlike(self.compile(args[0]), F.lit(to_java(str(args[1].value))))
        if name in UNSUPPORTED or name.startswith("geo."):
            raise unsupported(f"the function {name} is not supported")
        short = name.rpartition(".")[2]
        if short in ("isnode", "isroot", "isleaf", "isancestor", "isdescendant", "issibling"):
            from ravelin.operators.hierarchy import hierarchy_test

            return hierarchy_test(self, short, dict(node.named))
        if name in self.ctx.model.functions:
            return self.ctx.model.functions[name](*[self.compile(a) for a in args], **{k: self.compile(v) for k, v in node.named})
        if name not in FUNCTIONS:
            raise unsupported(f"the function {name} is not supported")
        least, most, build = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise bad(f"{name} takes {least} to {most} arguments")
        return build(*[self.compile(a) for a in args])

    def cast(self, node: Call) -> Column:
        args = node.arguments
        target = args[-1]
        if not isinstance(target, Path):
            raise bad(f"{node.name} needs a type")
        type_name = str(target).replace("/", ".")
        subject = args[0] if len(args) > 1 else None
        if type_name.startswith("Edm."):
            if subject is None:
                raise bad("a primitive type needs an expression")
            column = self.compile(subject)
            kind = self.type_of(column)
            wide = WIDER.get(type_name)
            rank = lambda k: _RANK.get(k.partition("(")[0], -1)
            same = {"Edm.String": "string", "Edm.Boolean": "boolean", "Edm.Date": "date", "Edm.DateTimeOffset": "timestamp_ntz"}.get(type_name) == kind
            if not same and (wide is None or rank(kind) < 0 or rank(kind) > rank(wide)):
                raise unsupported(f"{node.name} from {kind} to {type_name}")
            if node.name == "isof":
                return F.lit(True)
            return column if same else column.cast(wide)
        prefix = ""
        if subject is not None:
            self.value(subject) if isinstance(subject, Path) else None
            prefix = str(subject)
        test = self._is_type(prefix, type_name)
        return test if node.name == "isof" else F.when(test, self._key_of(prefix))

    def quantified(self, node: Quantified) -> Column:
        if len(node.path.segments) and self._array(node.path) is not None:
            return self.over_array(node)
        known = str(node)
        if known not in self.done:
            def totals(frame: Frame) -> dict[str, Column]:
                if node.body is None:
                    return {"n": F.count(F.lit(1)), "yes": F.count(F.lit(1)), "no": F.lit(0).cast("long")}
                truth = frame.compile(node.body)
                return {"n": F.count(F.lit(1)), "yes": F.count_if(truth), "no": F.count_if(~truth)}

            # The body's joins change the member frame, so it is compiled before the grouping.
            got, exists = self.gather(node.path, totals, node.variable, (node.body,) if node.body is not None else ())
            n, yes, no = (F.coalesce(got[k], F.lit(0)) for k in ("n", "yes", "no"))
            value = F.when(yes > 0, True).when(n == no, False) if node.kind == "any" else F.when(n == yes, True).when(no > 0, False)
            if node.kind == "all":  # a member whose condition is null fails all
                value = F.when(n == yes, True).otherwise(F.when(no > 0, False))
            name = fresh("any")
            self.df = self.df.withColumn(name, value if exists is None else F.when(exists, value))
            self.done[known] = name
        return c(self.done[known])

    def _array(self, path: Path) -> Column | None:
        prefix, segments = self._start(path.segments)
        name = "/".join(([prefix] if prefix else []) + list(segments))
        if name in self.df.columns and isinstance(self._kind(name), T.ArrayType):
            return c(name)
        return None

    def over_array(self, node: Quantified) -> Column:
        array = self._array(node.path)
        assert array is not None
        if node.body is None:
            return F.size(array) > 0

        def truth(x: Column) -> Column:
            return _over_element(self, array, node.body, node.variable or "", x)  # type: ignore[arg-type]

        if node.kind == "any":
            return F.exists(array, truth)
        return F.forall(array, lambda x: F.coalesce(truth(x), F.lit(False)))

    def counted(self, path: Path, where: Node | None) -> Column:
        if path.segments == ("$these",):
            return self.of_these(AggregateItem(None, None, ""))
        array = self._array(path)
        if array is not None:
            return F.size(array) if where is None else F.size(F.filter(array, lambda x: F.coalesce(_over_element(self, array, where, "$this", x), F.lit(False))))
        known = str(Counted(path, where))
        if known not in self.done:
            def totals(frame: Frame) -> dict[str, Column]:
                frame.outer["$this"] = ""
                return {"n": F.count(F.lit(1)) if where is None else F.count_if(frame.compile(where))}

            got, exists = self.gather(path, totals, None, (where,) if where is not None else ())
            value = F.coalesce(got["n"], F.lit(0))
            name = fresh("count")
            self.df = self.df.withColumn(name, value if exists is None else F.when(exists, value))
            self.done[known] = name
        return c(self.done[known])

    def aggregated(self, path: Path, item: AggregateItem) -> Column:
        if path.segments == ("$these",):
            return self.of_these(item)
        known = str(Aggregated(path, item))
        if known not in self.done:
            if item.expression is None:
                return self.counted(path, None)
            if item.method not in ("sum", "min", "max", "average"):
                raise unsupported(f"{item.method} over a navigation")

            def totals(frame: Frame) -> dict[str, Column]:
                column = frame.compile(item.expression)  # type: ignore[arg-type]
                if item.method in ("sum", "average") and frame.type_of(column).partition("(")[0] not in _RANK:
                    raise bad(f"{item.method} of {item.expression}, which is no number")
                return {"value": aggregate_column(self.ctx.model, item.method or "", column)}

            got, _ = self.gather(path, totals)
            name = fresh("agg")
            self.df = self.df.withColumn(name, got["value"])
            self.done[known] = name
        return c(self.done[known])

    def of_these(self, item: AggregateItem) -> Column:
        """An aggregate of the current collection: one row, joined to all (or one for each group)."""
        known = f"$these/{item}/{id(self.these)}"
        if known not in self.done:
            base = self.copy(df=self.these if self.these is not None else self.df, done={})
            column = F.count(F.lit(1)) if item.expression is None else aggregate_column(self.ctx.model, item.method or "", base.compile(item.expression))
            name = fresh("these")
            if self.partition:
                keys = [fresh("part") for _ in self.partition]
                side = base.df.groupBy(*[c(p).alias(k) for p, k in zip(self.partition, keys, strict=True)]).agg(column.alias(name))
                condition = F.lit(True)
                for p, k in zip(self.partition, keys, strict=True):
                    condition &= c(p).eqNullSafe(c(k))
                self.df = self.df.join(side, condition, "left").drop(*keys)
            else:
                self.df = self.df.crossJoin(F.broadcast(base.df.agg(column.alias(name))))  # one row
            self.done[known] = name
        return c(self.done[known])

    # --- results ---

    def result(self, names: list[str] | None = None) -> DataFrame:
        return self.df.select(*[c(n) for n in (names or self.shape)])

    def keys(self) -> list[str]:
        """Columns of a total order: the key, or everything that has an order."""
        if self.set is not None and self.set.key and all(k in self.df.columns for k in self.set.key):
            return list(self.set.key)
        ordered = [n for n in self.shape if not isinstance(self._kind(n), T.MapType | T.VariantType)]
        return ordered


def literal(node: Literal, kind: str | None = None) -> Column:
    match node.kind:
        case "null":
            return F.lit(None)
        case "date" | "datetime":
            text = str(node.value)
            if kind == "date":
                return F.lit(text[:10]).cast("date")
            if node.kind == "date" and kind is None:
                return F.lit(text).cast("date")
            stamp = F.lit(_utc(text)).cast(kind if kind == "timestamp" else "timestamp_ntz")
            return stamp
        case "decimal":
            return F.lit(node.value if isinstance(node.value, Decimal) else Decimal(str(node.value)))
        case "duration":
            return F.lit(_seconds(str(node.value)))
        case "time":
            return F.lit(str(node.value) if str(node.value).count(":") == 2 else f"{node.value}:00")
        case "enum":
            return F.lit(node.value[1])  # type: ignore[index]
    return F.lit(node.value)


def _utc(text: str) -> str:
    """A date-time literal as UTC without an offset."""
    import datetime as dt
    import re

    if "T" not in text:
        return f"{text} 00:00:00"
    m = re.fullmatch(r"(.*?)(Z|[+-]\d\d:\d\d)?", text)
    assert m
    body, offset = m[1], m[2]
    body = body if body.count(":") == 2 else body + ":00"
    if offset in (None, "Z"):
        return body.replace("T", " ")
    fraction = body.partition(".")[2]
    moment = dt.datetime.fromisoformat(body.partition(".")[0] + offset).astimezone(dt.UTC).replace(tzinfo=None)
    return moment.isoformat(" ") + (f".{fraction}" if fraction else "")


def _seconds(text: str) -> float:
    import re

    m = re.fullmatch(r"(-)?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m:
        raise bad(f"bad duration {text}")
    days, hours, minutes, seconds = (float(x or 0) for x in m.groups()[1:])
    return (-1 if m[1] else 1) * (days * 86400 + hours * 3600 + minutes * 60 + seconds)


def aggregate_column(model: EntityModel, method: str, column: Column) -> Column:
    match method:
        case "sum":
            return F.sum(column)
        case "average":
            return F.avg(column)
        case "min":
            return F.min(column)
        case "max":
            return F.max(column)
        case "countdistinct":
            return F.countDistinct(column)
    if method in model.methods:
        return model.methods[method](column)
    raise bad(f"unknown aggregation method {method}")


def _mentions(node: Node | None, names: set[str]) -> bool:
    if isinstance(node, Path):
        return node.segments[0] in names
    parts: list = []
    match node:
        case Unary(_, x):
            parts = [x]
        case Binary(_, a, b):
            parts = [a, b]
        case Call(_, args, named):
            parts = [*args, *(v for _, v in named)]
        case Quantified(path, _, _, body) | Counted(path, body) if isinstance(node, Quantified | Counted):
            parts = [path, body]
        case Aggregated(path, item):
            parts = [path, item.expression]
        case Items(items):
            parts = list(items)
    return any(_mentions(p, names) for p in parts if p is not None)


def arithmetic(op: str, x: Column, y: Column, types: Callable[[], tuple[str, str]]) -> Column:
    """``x op y``; div of integers is integer division, and by zero both kinds give null."""
    match op:
        case "add":
            return x + y
        case "sub":
            return x - y
        case "mul":
            return x * y
        case "mod":
            return F.try_mod(x, y)
        case "divby":
            return F.try_divide(x, y)
    if all(t in INTEGERS for t in types()):
        return F.when(y != 0, F.call_function("div", x, F.when(y != 0, y)))
    return F.try_divide(x, y)


def two_valued(op: str, x: Column, y: Column, kinds: tuple[str, str]) -> Column:
    """A comparison that is false with a null or NaN operand (ne: true)."""
    other = op == "ne"
    result = F.coalesce(COMPARE[op](x, y), F.lit(other))
    for z, kind in zip((x, y), kinds, strict=True):
        if kind in ("double", "float"):
            result = F.when(F.coalesce(F.isnan(z), F.lit(False)), F.lit(other)).otherwise(result)
    return result


def _over_element(frame: Frame, array: Column, node: Node, variable: str, x: Column) -> Column:
    """A condition over one element of an array column."""

    def kind(n: Node) -> str:
        if isinstance(n, Literal):
            return frame.type_of(frame.compile(n))
        return frame.type_of(F.get(F.transform(array, lambda e: _over_element(frame, array, n, variable, e)), F.lit(0)))

    def go(n: Node) -> Column:
        match n:
            case Path(segments) if segments[0] == variable:
                out = x
                for s in segments[1:]:
                    out = out.getField(s)
                return out
            case Binary(op, a, b) if op in COMPARE:
                if isinstance(a, Literal) and not isinstance(b, Literal):
                    a, b = b, a
                    op = {"gt": "lt", "lt": "gt", "ge": "le", "le": "ge"}.get(op, op)
                if isinstance(b, Literal) and b.kind == "null":
                    return go(a).isNull() if op == "eq" else go(a).isNotNull() if op == "ne" else F.lit(False)
                of = kind(a)
                y = frame.fitted(b, of) if isinstance(b, Literal) else go(b)
                return two_valued(op, go(a), y, (of, kind(b)))
            case Binary("and", a, b):
                return go(a) & go(b)
            case Binary("or", a, b):
                return go(a) | go(b)
            case Binary("in", a, Items(items)):
                if not all(isinstance(i, Literal) for i in items):
                    raise unsupported("in with other than literals")
                return frame.among(go(a), kind(a), items)
            case Binary("has", a, b) if isinstance(b, Literal):
                mask = frame.enum_value(b, "int") if b.kind == "enum" else F.lit(b.value)
                return go(a).bitwiseAND(mask) == mask
            case Binary(op, a, b):
                return arithmetic(op, go(a), go(b), lambda: (kind(a), kind(b)))
            case Unary("not", a):
                return ~go(a)
            case Unary(_, a):
                return -go(a)
            case Call(name, args, ()) if name in FUNCTIONS:
                return FUNCTIONS[name][2](*[go(a) for a in args])
            case Call("matchesPattern", (a, Literal(value, _)), ()):
                return F.rlike(go(a), F.lit(to_java(str(value))))
        return frame.compile(n)

    return go(node)


__all__ = ["BOOLEAN", "Context", "Frame", "aggregate_column", "c", "fresh", "literal"]
