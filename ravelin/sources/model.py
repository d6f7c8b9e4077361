"""Entity models: sets with keys, navigations, derived types, hierarchies and timelines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession

from ravelin.errors import QueryError, bad

Loader = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Nav:
    """A navigation: rows of ``target`` with remote columns equal to the owner's local ones.

    Many-to-many goes through a bridge: local = bridge columns, bridge columns = remote.
    """

    name: str
    target: str
    on: tuple[tuple[str, str], ...]
    many: bool = False
    bridge: Loader | None = None
    through: tuple[tuple[str, str], ...] = ()  # (bridge column, remote), with ``on`` as (local, bridge column)
    declared_in: str | None = None  # derived type


@dataclass(frozen=True)
class Hierarchy:
    """A recursive hierarchy: each node value and its parent's (null: a root). Parents may be several rows."""

    node: str
    parent: str | None = None
    edges: Loader | None = None  # (node, parent) for several parents


@dataclass(frozen=True)
class Timeline:
    """Rows are slices of application time of an object."""

    object_key: tuple[str, ...]
    start: str
    end: str
    closed: bool = False  # an end belongs to its slice


@dataclass(frozen=True)
class Enum:
    members: tuple[tuple[str, int], ...]
    flags: bool = False


@dataclass
class EntitySet:
    name: str
    type_name: str
    key: tuple[str, ...]
    load: Loader
    navs: tuple[Nav, ...] = ()
    type_column: str | None = None
    subtypes: dict[str, tuple[str, ...]] = field(default_factory=dict)  # type -> it and all below
    derived: dict[str, str] = field(default_factory=dict)  # property -> type that declares it
    searchable: tuple[str, ...] | None = None  # None: every string
    enums: dict[str, str] = field(default_factory=dict)  # property -> enum
    dynamic: str | None = None  # column with a JSON object of dynamic properties
    hierarchies: dict[str, Hierarchy] = field(default_factory=dict)
    timeline: Timeline | None = None
    visible: Callable[[DataFrame], Column] | None = None
    not_filterable: frozenset[str] = frozenset()
    not_sortable: frozenset[str] = frozenset()
    not_groupable: frozenset[str] = frozenset()
    not_aggregatable: frozenset[str] = frozenset()
    validation: dict[str, dict[str, object]] = field(default_factory=dict)  # property -> validation terms and their values
    stream: tuple[str, str] | None = None  # (binary column, content type column)

    def nav(self, name: str) -> Nav | None:
        return next((n for n in self.navs if n.name == name), None)

    def types_of(self, name: str) -> tuple[str, ...]:
        short = name.rpartition(".")[2]
        if short == self.type_name and short not in self.subtypes:
            return (short,)
        if short not in self.subtypes:
            raise bad(f"{name} is no type of {self.name}")
        return self.subtypes[short]


class Overloads:
    """An operation with several parameter lists: the one that has exactly the names (and types) given is called."""

    def __init__(self, *options: tuple[dict[str, type], Callable]):
        self.options = options

    def __call__(self, *bound, **named):
        for parameters, f in self.options:
            if set(parameters) == set(named) and all(v is None or isinstance(v, kind) or (kind is float and isinstance(v, int | Decimal)) for (k, kind) in parameters.items() for v in (named[k],)):
                return f(*bound, **named)
        raise bad(f"no overload with the parameters {', '.join(sorted(named)) or 'none'} of these types")


@dataclass
class EntityModel:
    sets: dict[str, EntitySet] = field(default_factory=dict)
    enums: dict[str, Enum] = field(default_factory=dict)
    namespace: str = "Default"
    methods: dict[str, Callable[[Column], Column]] = field(default_factory=dict)  # custom aggregation methods
    aggregates: dict[str, Callable[[], Column]] = field(default_factory=dict)  # custom aggregates
    functions: dict[str, Callable] = field(default_factory=dict)

    def add(self, entity_set: EntitySet) -> EntitySet:
        self.sets[entity_set.name] = entity_set
        return entity_set

    def set(self, name: str) -> EntitySet:
        if name not in self.sets:
            raise QueryError(404, f"no entity set {name}")
        return self.sets[name]
