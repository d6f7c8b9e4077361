"""The $apply pipeline: each transformation takes a frame and gives a frame.

A per-group sequence never loops over groups: the group's keys become the
frame's partition, and every transformation inside keeps groups apart by them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ravelin.errors import bad, unsupported
from ravelin.operators import hierarchy
from ravelin.operators.expand import expand
from ravelin.operators.frame import Frame, aggregate_column, c, fresh
from ravelin.operators.search import matches
from ravelin.operators.select_top import best
from ravelin.plans.tree import AggregateItem, Counted, Expansion, Options, Order, Path, Step


def run(frame: Frame, steps: tuple[Step, ...]) -> Frame:
    for step in steps:
        frame = apply(frame, step)
    return frame


def apply(frame: Frame, step: Step) -> Frame:
    frame = frame.copy(these=frame.df, done={})
    match step.kind:
        case "identity":
            return frame
        case "filter":
            condition = frame.condition(step.args[0])
            return frame.with_df(frame.df.filter(condition))
        case "search":
            condition = matches(frame, step.args[0])
            return frame.with_df(frame.df.filter(condition))
        case "compute":
            for item in step.args[0]:
                if item.name in frame.shape:
                    raise bad(f"the name {item.name} is taken")
                value = frame.compile(item.expression)
                frame.df = frame.df.withColumn(item.name, value)
                frame.shape.append(item.name)
                frame.computed[item.name] = None
            return frame
        case "orderby":
            return ordered(frame, step.args[0])
        case "top" | "skip":
            return sliced(frame, step.kind, step.args[0])
        case "aggregate":
            return grouped(frame, [], step.args[0])
        case "groupby":
            return groupby(frame, *step.args)
        case "concat":
            return concat(frame, step.args[0])
        case "join" | "outerjoin":
            return join(frame, *step.args, outer=step.kind == "outerjoin")
        case "expand":
            return expanded(frame, *step.args)
        case "ancestors" | "descendants":
            return hierarchy.related(frame, step.kind, step.args, run)
        case "traverse":
            return hierarchy.traverse(frame, step.args)
    return best(frame, step.kind, *step.args)


def ordered(frame: Frame, orders: tuple[Order, ...]) -> Frame:
    columns = []
    for o in orders:
        name = fresh("by")
        value = frame.compile(o.expression)
        frame.df = frame.df.withColumn(name, value)
        columns.append((c(name), o.descending))
    frame.order = columns + [(c(k), False) for k in frame.keys()]
    if not frame.partition:
        frame.df = frame.df.orderBy(*[sort(x, d) for x, d in frame.order])
    return frame


def sort(column: Column, descending: bool) -> Column:
    return column.desc_nulls_last() if descending else column.asc_nulls_first()


def sliced(frame: Frame, kind: str, n: int) -> Frame:
    order = frame.order or [(c(k), False) for k in frame.keys()]
    by = [sort(x, d) for x, d in order]
    if frame.partition:
        place = fresh("place")
        rows = frame.df.withColumn(place, F.row_number().over(Window.partitionBy(*[c(p) for p in frame.partition]).orderBy(*by)))
        return frame.with_df(rows.where(c(place) <= n if kind == "top" else c(place) > n).drop(place))
    rows = frame.df.orderBy(*by)
    return frame.with_df(rows.limit(n) if kind == "top" else rows.offset(n))


def _aggregate(frame: Frame, item: AggregateItem, extra: dict[str, list[Column]]) -> Column:
    """The Column of one aggregate; over a collection, from a row for each owner."""
    e = item.expression
    if e is None:
        return F.count(F.lit(1))
    if isinstance(e, Counted):
        return F.sum(frame.counted(e.path, e.filter))
    if isinstance(e, Path) and item.method is None:
        name = e.segments[0]
        if name not in frame.ctx.model.aggregates or frame.set is None:
            raise bad(f"{name} needs an aggregation method")
        return frame.ctx.model.aggregates[name]()
    if frame.set is not None and isinstance(e, Path) and e.segments[-1] in frame.set.not_aggregatable:
        raise bad(f"{e} can't be aggregated")
    if isinstance(e, Path):
        for i in range(1, len(e.segments)):
            head, tail = Path(e.segments[:i]), Path(e.segments[i:])
            if _is_collection(frame, head):
                return _over_members(frame, head, tail, item.method or "")
    return aggregate_column(frame.ctx.model, item.method or "", frame.compile(e))


def _is_collection(frame: Frame, path: Path) -> bool:
    entity = frame.places.get("")
    prefix = ""
    for i, s in enumerate(path.segments):
        prefix = f"{prefix}/{s}" if prefix else s
        if prefix in frame.places:
            entity = frame.places[prefix]
            continue
        nav = entity.nav(s) if entity else None
        if nav is None:
            return False
        if nav.many:
            return i == len(path.segments) - 1
        entity = frame.ctx.model.set(nav.target)
    return False


def _over_members(frame: Frame, head: Path, tail: Path, method: str) -> Column:
    """Every member's value of every owner: sums of sums, so that no join fans out."""
    if method not in ("sum", "min", "max", "average"):
        raise unsupported(f"{method} over a collection")

    def totals(member: Frame) -> dict[str, Column]:
        value = member.compile(tail)
        if method == "average":
            return {"s": F.sum(value), "n": F.count(value)}
        return {"v": aggregate_column(frame.ctx.model, method, value)}

    got, _ = frame.gather(head, totals)
    if method == "average":
        return F.sum(got["s"]) / F.sum(got["n"])
    return aggregate_column(frame.ctx.model, method, got["v"])


def grouped(frame: Frame, keys: list[Path], items: tuple[AggregateItem, ...]) -> Frame:
    names: list[str] = []
    for key in keys:
        if frame.set is not None:
            if key.segments[-1] in frame.set.not_groupable:
                raise bad(f"{key} can't be grouped by")
            if str(key) not in frame.df.columns and frame.is_navigation(key):
                raise unsupported(f"grouping by the navigation {key}")
        value = frame.value(key)
        name = str(key)
        if name not in frame.df.columns:
            frame.df = frame.df.withColumn(name, value)
        names.append(name)
    for item in items:
        if item.alias in names:
            raise bad(f"the name {item.alias} is taken")
    columns = [_aggregate(frame, item, {}).alias(item.alias) for item in items]
    by = [*frame.partition, *[n for n in names if n not in frame.partition]]
    if columns:
        df = frame.df.groupBy(*[c(n) for n in by]).agg(*columns)
    else:
        df = frame.df.select(*[c(n) for n in by]).distinct()
    return Frame(frame.ctx, df, None, [*by, *[i.alias for i in items]], {}, {}, {}, list(frame.partition))


def groupby(frame: Frame, keys: tuple[Path, ...], then: tuple[Step, ...]) -> Frame:
    if not then:
        return grouped(frame, list(keys), ())
    if len(then) == 1 and then[0].kind == "aggregate":
        return grouped(frame, list(keys), then[0].args[0])
    names = []
    for key in keys:
        value = frame.value(key)
        if str(key) not in frame.df.columns:
            frame.df = frame.df.withColumn(str(key), value)
        names.append(str(key))
    outer = list(frame.partition)
    inside = frame.copy(partition=[*outer, *[n for n in names if n not in outer]], order=[])
    out = run(inside, then)
    if out.set is not None:
        raise unsupported("a sequence in groupby that does not end in groups")
    return out.copy(partition=outer)


def concat(frame: Frame, sequences: tuple[tuple[Step, ...], ...]) -> Frame:
    parts = [run(frame.copy(done={}), s) for s in sequences]
    if len({p.set is None for p in parts}) > 1:
        raise unsupported("concat of entities and groups")
    shape = list(dict.fromkeys(n for p in parts for n in p.shape))
    whole = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.result() for p in parts])
    first = parts[0]
    return Frame(frame.ctx, whole, first.set, shape, {"": first.set} if first.set is not None else {}, {}, dict(first.computed), list(frame.partition))


def join(frame: Frame, nav_name: str, alias: str, then: tuple[Step, ...], outer: bool) -> Frame:
    """Each row once for each member; the alias acts as a to-one afterwards."""
    if frame.set is None:
        raise unsupported("a join after a grouping")
    if alias in frame.shape or alias in frame.places:
        raise bad(f"the name {alias} is taken")
    nav = frame.set.nav(nav_name)
    if nav is None or not nav.many:
        raise bad(f"{nav_name} is no collection")
    member, remote = frame.members(nav, None)
    inside = member.copy(partition=remote)
    done = run(inside, then) if then else inside
    if done.set is None:
        raise unsupported("a join's sequence must leave entities")
    keys = [fresh("key") for _ in remote]
    side = done.df.select(*[c(r).alias(k) for r, k in zip(remote, keys, strict=True)], *[c(n).alias(f"{alias}/{n}") for n in done.shape])
    condition = functools.reduce(lambda a, b: a & b, [c(a) == c(k) for (a, _), k in zip(nav.on, keys, strict=True)])
    frame.df = frame.df.join(side, condition, "left" if outer else "inner").drop(*keys)
    frame.places[alias] = done.set
    frame.shape += [f"{alias}/{n}" for n in done.shape]
    return frame


def expanded(frame: Frame, nav: str, then: tuple[Step, ...]) -> Frame:
    condition = None
    for step in then:
        if step.kind != "filter":
            raise unsupported(f"{step.kind} in expand")
        condition = step.args[0]
    return expand(frame, (Expansion(nav, Options(filter=condition)),))
