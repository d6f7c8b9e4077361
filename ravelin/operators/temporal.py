"""Application time: slices valid at a moment or in a period, and changes for a portion of time."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.errors import bad
from ravelin.operators.frame import Frame, c, literal
from ravelin.operators.hierarchy import _cut
from ravelin.plans.tree import Literal, Options
from ravelin.sources.model import Timeline

OPEN = "9999-12-31 00:00:00"


def far(end: Column, kind: str) -> Column:
    """An end as an exact bound: null and from 9999-12-31 on are open."""
    return F.coalesce(end, F.lit(OPEN).cast(kind))


def in_time(frame: Frame, options: Options) -> Column | None:
    """The condition that $at, $from, $to and $toInclusive set; None without any or on a set without time."""
    given = [x for x in (options.at, options.from_, options.to, options.to_inclusive) if x is not None]
    if not given or frame.set is None or frame.set.timeline is None:
        return None
    line = frame.set.timeline
    kind = frame.df.schema[line.start].dataType.simpleString()
    start, end = c(line.start), far(c(line.end), kind)
    moment = lambda x: literal(x, kind)
    if options.at is not None:
        if len(given) > 1:
            raise bad("$at with another time option")
        t = moment(options.at)
        last = F.lit(OPEN).cast(kind)
        return (start <= t) & ((end >= t) if line.closed else ((end > t) | (end >= last)))
    if options.from_ is None or (options.to is not None and options.to_inclusive is not None):
        raise bad("a period needs $from and at most one of $to and $toInclusive")
    after = end >= moment(options.from_) if line.closed else end > moment(options.from_)
    if options.to is not None:
        return after & (start < moment(options.to))
    if options.to_inclusive is not None:
        return after & (start <= moment(options.to_inclusive))
    return after


def _bounds(delta: dict, kind: str) -> tuple[Column, Column]:
    start = literal(Literal(delta["start"], "datetime"), kind)
    end = literal(Literal(delta["end"], "datetime"), kind) if delta.get("end") else F.lit(OPEN).cast(kind)
    return start, end


def _pieces(df: DataFrame, line: Timeline, delta: dict, inside: str) -> DataFrame:
    """Splits the slices of the delta's object that its period overlaps; ``inside``: update or delete."""
    kind = df.schema[line.start].dataType.simpleString()
    a, b = _bounds(delta, kind)
    start, end = c(line.start), far(c(line.end), kind)
    mine = functools.reduce(lambda x, y: x & y, [c(k) == F.lit(v) for k, v in delta["key"].items()])
    hit = mine & (start < b) & (end > a)
    columns = df.columns

    def piece(s: Column, e: Column, changed: bool) -> Column:
        out = []
        for name in columns:
            if name == line.start:
                out.append(s.cast(kind).alias(name))
            elif name == line.end:
                out.append(F.when(e < F.lit(OPEN).cast(kind), e).alias(name))
            elif changed and name in delta.get("values", {}):
                out.append(F.lit(delta["values"][name]).cast(df.schema[name].dataType).alias(name))
            else:
                out.append(c(name).alias(name))
        return F.struct(*out, F.lit(True).alias("__touched"))

    before = F.when(start < a, piece(start, a, False))
    middle = piece(F.greatest(start, a), F.least(end, b), True)
    after = F.when(end > b, piece(b, end, False))
    parts = F.array_compact(F.array(before, middle, after) if inside == "update" else F.array(before, after))
    same = F.struct(*[c(n).alias(n) for n in columns], (c("__touched") if "__touched" in columns else F.lit(False)).alias("__touched"))
    if "__touched" in columns:
        same = F.struct(*[c(n).alias(n) for n in columns])
        parts = F.transform(parts, lambda p: F.struct(*[p[n].alias(n) for n in columns if n != "__touched"], F.lit(True).alias("__touched")))
    return df.select(F.explode(F.when(hit, parts).otherwise(F.array(same))).alias("p")).select("p.*")


def _marked(df: DataFrame) -> DataFrame:
    return df if "__touched" in df.columns else df.withColumn("__touched", F.lit(False))


def update(df: DataFrame, line: Timeline, deltas: Sequence[dict]) -> DataFrame:
    """``FOR PORTION OF``: overlapped slices split at the delta's edges, the inside changed. Deltas apply in order."""
    for delta in deltas:
        df = _pieces(_marked(df), line, delta, "update")
    return _marked(df)


def delete(df: DataFrame, line: Timeline, deltas: Sequence[dict]) -> DataFrame:
    for delta in deltas:
        df = _pieces(_marked(df), line, delta, "delete")
    return _marked(df)


def removed_periods(df: DataFrame, line: Timeline, delta: dict) -> DataFrame:
    """The periods that a deletion takes away, one row for each slice that it meets."""
    kind = df.schema[line.start].dataType.simpleString()
    a, b = _bounds(delta, kind)
    start, end = c(line.start), far(c(line.end), kind)
    mine = functools.reduce(lambda x, y: x & y, [c(k) == F.lit(v) for k, v in delta["key"].items()])
    cut = F.least(end, b)
    return df.where(mine & (start < b) & (end > a)).select(*[c(k) for k in line.object_key], F.greatest(start, a).alias(line.start), F.when(cut < F.lit(OPEN).cast(kind), cut).alias(line.end))


def upsert(df: DataFrame, line: Timeline, deltas: Sequence[dict]) -> DataFrame:
    """Update, and new slices where the object has gaps in the period: from the slice just before, else from the delta.

    Only the objects that deltas name are worked on; each delta's result is
    written, so that the plan of the next one does not hold it several times.
    """
    if not deltas:
        return _marked(df)
    named = functools.reduce(lambda x, y: x | y, [functools.reduce(lambda x, y: x & y, [c(k) == F.lit(v) for k, v in d["key"].items()], F.lit(bool(d["key"]))) for d in deltas])
    mine_all = F.coalesce(named, F.lit(False))
    rest, df = _marked(df).where(~mine_all), _marked(df).where(mine_all)
    for turn, delta in enumerate(deltas):
        if turn:
            df = _cut(df)
        if set(delta["key"]) != set(line.object_key):
            raise bad("an upsert needs the whole object key")
        base = _marked(df)
        kind = base.schema[line.start].dataType.simpleString()
        a, b = _bounds(delta, kind)
        changed = _pieces(base, line, delta, "update")
        mine = functools.reduce(lambda x, y: x & y, [c(k) == F.lit(v) for k, v in delta["key"].items()])
        own = changed.where(mine).select(*[c(n) for n in changed.columns], far(c(line.end), kind).alias("__end"))
        w = Window.partitionBy(*[c(k) for k in line.object_key]).orderBy(c(line.start))
        spans = own.withColumn("__next", F.coalesce(F.lead(c(line.start)).over(w), F.lit(OPEN).cast(kind)))
        values = {k: F.lit(v) for k, v in delta.get("values", {}).items()} | {k: F.lit(v) for k, v in delta["key"].items()}

        def filled(row: str, s: Column, e: Column, from_row: bool, values=values, changed=changed, line=line, kind=kind) -> Column:
            out = []
            for f in changed.schema.fields:
                if f.name == line.start:
                    x = s
                elif f.name == line.end:
                    x = F.when(e < F.lit(OPEN).cast(kind), e)
                elif f.name == "__touched":
                    x = F.lit(True)
                elif f.name in values:
                    x = values[f.name]
                else:
                    x = c(f.name) if from_row else F.lit(None)
                out.append(x.cast(f.dataType).alias(f.name))
            return F.struct(*out)

        gap_from, gap_to = F.greatest(c("__end"), a), F.least(c("__next"), b)
        gaps = spans.where(gap_from < gap_to).select(filled("", gap_from, gap_to, True).alias("p")).select("p.*")
        # The stretch before the object's first slice, or all of it for a new object.
        head = own.agg(F.min(c(line.start)).alias("first"))
        lead_to = F.least(F.coalesce(F.col("first"), F.lit(OPEN).cast(kind)), b)
        lead = head.where(a < lead_to).select(filled("", a, lead_to, False).alias("p")).select("p.*")
        df = changed.unionByName(gaps).unionByName(lead)
    return rest.unionByName(df)


def touched(df: DataFrame, line: Timeline) -> DataFrame:
    """Each touched slice once, by object key and start."""
    return df.where("__touched").drop("__touched").distinct().orderBy(*[c(k) for k in line.object_key], c(line.start))
