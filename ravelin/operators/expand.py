"""$expand: nested structs and arrays by one join for each navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.errors import bad, unsupported
from ravelin.operators.frame import Frame, c, fresh
from ravelin.operators.hierarchy import _cut
from ravelin.operators.search import matches
from ravelin.operators.temporal import in_time
from ravelin.plans.tree import Expansion, Options, Path
from ravelin.sources.model import Nav

DEEPEST, MOST_LEVELS = 8, 32


def expand(frame: Frame, items: tuple[Expansion, ...], depth: int = 1) -> Frame:
    if items and frame.set is None:
        raise bad("$expand on grouped rows")
    if depth > DEEPEST:
        raise bad("$expand is nested too deeply")
    frame = frame.copy()
    for item in items:
        if item.path == "*":
            for nav in frame.set.navs:  # type: ignore[union-attr]
                one(frame, nav, Expansion(nav.name, item.options, item.suffix), None, depth)
            continue
        cast, _, name = item.path.rpartition("/")
        nav = frame.set.nav(name)  # type: ignore[union-attr]
        if nav is None:
            raise bad(f"no navigation {name}")
        one(frame, nav, item, cast or nav.declared_in, depth)
    return frame


def levels(options: Options) -> Options:
    """``$levels=n``; ``max`` is bounded."""
    if options.levels is None:
        return options
    n = MOST_LEVELS if options.levels == "max" else int(options.levels)
    return Options(**(options.__dict__ | {"levels": n}))


def leveled(frame: Frame, nav: Nav, options: Options, cast: str | None, whole: bool, depth: int) -> None:
    """``$levels``: the same expansion inside itself. An object that its own path holds is shown, but not expanded again.

    Paths grow by one join for each level, from the owners down; with ``whole``
    (``max``) until no path goes on, so the result is as deep as the data. Then
    levels are gathered from the deepest up.
    """
    most = int(options.levels or 1)
    options = Options(**(options.__dict__ | {"levels": None}))
    member, remote = frame.members(nav, None)
    member = expand(prepared(member, options), options.expand, depth + 1)
    only, order, keys = shown(member, options), ordering(member, options), member.keys()
    name = lambda names: F.to_json(F.struct(*[c(k).alias(k) for k in names]))
    local = [a for a, _ in nav.on]
    rows = member.df.withColumn("__place", F.row_number().over(Window.partitionBy(*[c(r) for r in remote]).orderBy(*order)))
    if options.skip:
        rows = rows.where(F.col("__place") > options.skip)
    if options.top is not None:
        rows = rows.where(F.col("__place") <= options.top + (options.skip or 0))
    rows = rows.select(*[c(r).alias(f"__r{k}") for k, r in enumerate(remote)], name(keys).alias("__me"), "__place", F.struct(*[c(n).alias(n) for n in only]).alias("__row"), *[c(a).alias(f"__next{k}") for k, a in enumerate(local)])
    own = F.array(name(frame.set.key))  # type: ignore[union-attr]
    start = frame.df if cast is None else frame.df.where(frame._is_type("", cast))
    frontier, found = start.select(own.alias("__path"), *[c(a).alias(f"__l{k}") for k, a in enumerate(local)]), []
    for _ in range(most):
        met = frontier
        for k in range(len(local)):
            met = met.withColumnRenamed(f"__l{k}", f"__at{k}")
        condition = F.lit(True)
        for k in range(len(local)):
            condition &= F.col(f"__at{k}") == F.col(f"__r{k}")
        met = met.join(rows, condition).withColumn("__again", F.array_contains("__path", F.col("__me")))
        if whole:
            met = _cut(met)
            if found and met.isEmpty():
                break
        found.append(met)
        frontier = met.where("not __again").select(F.concat("__path", F.array("__me")).alias("__path"), *[F.col(f"__next{k}").alias(f"__l{k}") for k in range(len(local))])
    below: DataFrame | None = None
    for met in reversed(found):
        fields = [F.col("__row").getField(n).alias(n) for n in only]
        if below is not None:
            met = met.join(below, F.concat("__path", F.array("__me")) == F.col("__of"), "left")
            value = F.col("__value")
            if nav.many:
                value = F.coalesce(value, F.array().cast(below.schema["__value"].dataType))
            fields.append(F.when(~F.col("__again"), value).alias(nav.name))
        entry = F.struct(F.col("__place").alias("place"), F.struct(*fields).alias("row"))
        gathered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["row"]) if nav.many else F.first(F.struct(*fields))
        below = met.groupBy(F.col("__path").alias("__of")).agg(gathered.alias("__value"))
    assert below is not None
    empty = F.array().cast(below.schema["__value"].dataType) if nav.many else F.lit(None)
    frame.df = frame.df.join(below, own == F.col("__of"), "left").withColumn(nav.name, F.coalesce("__value", empty) if nav.many else F.col("__value")).drop("__of", "__value")
    if nav.name not in frame.shape:
        frame.shape.append(nav.name)
        frame.expansions.append(nav.name)


def inner(nav: Nav, frame: Frame, options: Options, depth: int) -> tuple[Frame, list[str], DataFrame | None]:
    """Members of a navigation with nested options, before paging; and counts for each owner."""
    member, remote = frame.members(nav, None)
    member = prepared(member, options)
    member = expand(member, options.expand, depth + 1)
    counts = member.df.groupBy(*[c(r) for r in remote]).agg(F.count("*").alias("__n")) if options.count else None
    return member, remote, counts


def prepared(frame: Frame, options: Options) -> Frame:
    """Time, search, computed names and filter, in the order that all reads have."""
    frame = frame.copy(these=frame.df)
    time = in_time(frame, options)
    if time is not None:
        frame.df = frame.df.filter(time)
    if options.search is not None:
        frame.df = frame.df.filter(matches(frame, options.search))
    compute(frame, options)
    if options.filter is not None:
        condition = frame.condition(options.filter)
        frame.df = frame.df.filter(condition)
    return frame


def compute(frame: Frame, options: Options) -> None:
    for item in options.compute:
        if item.name in frame.shape:
            raise bad(f"the name {item.name} is taken")
        value = frame.compile(item.expression)
        frame.df = frame.df.withColumn(item.name, value)
        frame.shape.append(item.name)
        frame.computed[item.name] = None


def ordering(frame: Frame, options: Options) -> list[Column]:
    out = []
    for o in options.orderby:
        if frame.set is not None and str(o.expression) in frame.set.not_sortable:
            raise bad(f"{o.expression} can't be sorted by")
        e = frame.compile(o.expression)
        out.append(e.desc_nulls_last() if o.descending else e.asc_nulls_first())
    return [*out, *[c(k).asc_nulls_first() for k in frame.keys()]]


def shown(frame: Frame, options: Options) -> list[str]:
    return selected(frame, options.select)


def selected(frame: Frame, names: tuple[str, ...]) -> list[str]:
    """The output columns of a $select."""
    if not names:
        return list(frame.shape)
    out: list[str] = []
    nested = [n for n in frame.shape if n in frame.expansions]
    for name in names:
        if name == "*":
            out += [n for n in frame.shape if n not in frame.computed]
            continue
        bare = name.rpartition("/")[2] if "." in name.partition("/")[0] else name
        if bare in frame.shape:
            if bare != name and frame.set is not None:
                frame.df = frame.df.withColumn(bare, F.when(frame._is_type("", name.partition("/")[0]), c(bare)))
            out.append(bare)
        elif "/" in name and frame.set is not None:
            value = frame.value(Path(tuple(name.split("/"))))
            frame.df = frame.df.withColumn(name, value)
            out.append(name)
        elif not (frame.set is not None and frame.set.nav(bare)):
            raise bad(f"no property {name}")
    return list(dict.fromkeys([*out, *nested]))


def one(frame: Frame, nav: Nav, item: Expansion, cast: str | None, depth: int) -> None:
    """Adds the column ``nav.name`` (and ``nav@count``) to the frame."""
    options = levels(item.options)
    target = frame.ctx.model.set(nav.target)
    if options.levels is not None and int(options.levels) > 1 and not item.suffix and target.nav(nav.name) and frame.set is not None and target.name == frame.set.name:
        if options.count:
            raise unsupported("$count with $levels")
        leveled(frame, nav, options, cast, item.options.levels == "max", depth)
        return
    member, remote, counts = inner(nav, frame, options, depth)
    only = list(member.set.key) if item.suffix == "$ref" and member.set is not None else shown(member, options)
    keys = [fresh("key") for _ in remote]
    local = [a for a, _ in nav.on]
    condition = F.lit(True)
    for a, k in zip(local, keys, strict=True):
        condition &= c(a) == c(k)
    if cast:
        condition &= frame._is_type("", cast)
    keyed = [c(r).alias(k) for r, k in zip(remote, keys, strict=True)]
    if not nav.many:
        value = fresh("one")
        side = member.df.select(*keyed, F.struct(*[c(n).alias(n) for n in only]).alias(value))
        frame.df = frame.df.join(side, condition, "left").drop(*keys).withColumnRenamed(value, nav.name)
    elif item.suffix == "$count":
        side = member.df.groupBy(*keyed).agg(F.count("*").alias("__n"))
        frame.df = frame.df.join(side, condition, "left").drop(*keys).withColumn(f"{nav.name}@count", F.coalesce("__n", F.lit(0))).drop("__n")
        frame.shape.append(f"{nav.name}@count")
        frame.expansions.append(f"{nav.name}@count")
        return
    else:
        order = ordering(member, options)
        place = fresh("place")
        rows = member.df.withColumn(place, F.row_number().over(Window.partitionBy(*[c(r) for r in remote]).orderBy(*order)))
        if options.skip:
            rows = rows.where(c(place) > options.skip)
        if options.top is not None:
            rows = rows.where(c(place) <= options.top + (options.skip or 0))
        gathered = fresh("many")
        entry = F.struct(c(place).alias("place"), F.struct(*[c(n).alias(n) for n in only]).alias("row"))
        side = rows.groupBy(*keyed).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["row"]).alias(gathered))
        frame.df = frame.df.join(side, condition, "left").drop(*keys).withColumn(nav.name, F.coalesce(c(gathered), F.array().cast(side.schema[gathered].dataType))).drop(gathered)
        if counts is not None:
            ck = [fresh("key") for _ in remote]
            total = counts.select(*[c(r).alias(k) for r, k in zip(remote, ck, strict=True)], "__n")
            on = F.lit(True)
            for a, k in zip(local, ck, strict=True):
                on &= c(a) == c(k)
            frame.df = frame.df.join(total, on, "left").drop(*ck).withColumn(f"{nav.name}@count", F.coalesce("__n", F.lit(0))).drop("__n")
            frame.shape.append(f"{nav.name}@count")
            frame.expansions.append(f"{nav.name}@count")
    if nav.name not in frame.shape:
        frame.shape.append(nav.name)
        frame.expansions.append(nav.name)
