"""Change tracking: net changes between versions, change logs and delta reads."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.errors import QueryError
from ravelin.operators.frame import c


def row_hash(columns: list[str]) -> Column:
    """A fingerprint of the served values; nulls count, and so does where they stand."""
    parts = [F.coalesce(F.to_json(F.struct(c(x))), F.lit("{}")) for x in columns]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def snapshot_changes(before: DataFrame, after: DataFrame, key: list[str], served: list[str] | None = None) -> DataFrame:
    """Net changes: ``_change`` is inserted, updated or deleted; rows as they are after (deleted: key only).

    Changes of columns that are not served are invisible.
    """
    names = served or [x for x in after.columns if x not in key]
    mark = lambda df, tag: df.select(*[c(k).alias(k) for k in key], F.struct(*[c(n) for n in names]).alias(tag))
    a, b = mark(before, "__old"), mark(after, "__new")
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "deleted").when(~F.col("__old").eqNullSafe(F.col("__new")), "updated")
    return both.withColumn("_change", change).where("_change IS NOT NULL").select(*[c(k) for k in key], *[F.col("__new").getField(n).alias(n) for n in names], "_change")


def log_changes(log: DataFrame, key: list[str], since: int, version: str = "_version", op: str = "_op") -> DataFrame:
    """The net change of each object since a version, from an append-only log of insert, update and delete.

    Insert and then delete is told as deleted; the last row's values count.
    """
    names = [x for x in log.columns if x not in (*key, version, op)]
    later = log.where(c(version) > since)
    last = later.groupBy(*[c(k) for k in key]).agg(
        F.max_by(F.struct(*[c(n) for n in names], c(op).alias("__op")), c(version)).alias("last"),
        F.min_by(c(op), c(version)).alias("first"),
    )
    change = F.when(F.col("last.__op") == "delete", "deleted").when(F.col("first") == "insert", "inserted").otherwise("updated")
    values = [F.when(change != "deleted", F.col("last").getField(n)).alias(n) for n in names]
    return last.select(*[c(k) for k in key], *values, change.alias("_change"))


def delta_read(changes: DataFrame, condition: Column | None) -> DataFrame:
    """Changes as a filtered reader sees them: what no longer matches is reported as removed ("changed")."""
    matching = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    reason = F.when(F.col("_change") == "deleted", "deleted").when(matching, F.lit(None).cast("string")).otherwise("changed")
    return changes.withColumn("_removed", reason)


@dataclass(frozen=True)
class DeltaToken:
    version: int

    def check(self, oldest: int, newest: int) -> None:
        if self.version < oldest:
            raise QueryError(410, "the change history no longer reaches back so far")
        if self.version > newest:
            raise QueryError(400, "the token is of a later version")


def tracked_read(log: DataFrame, read: Callable[[], DataFrame], version: str = "_version") -> tuple[DeltaToken, DataFrame]:
    """A token and then the rows: taken first, so that a change in between is told again and never missed."""
    newest = log.agg(F.max(c(version))).first()[0]
    return DeltaToken(int(newest or 0)), read()


def token_at(log: DataFrame, moment: Column, at: str = "_at", version: str = "_version") -> DeltaToken:
    """The token of the state at a moment: the last version written until then."""
    newest = log.where(c(at) <= moment).agg(F.max(c(version))).first()[0]
    return DeltaToken(int(newest or 0))


def delta_page(changes: DataFrame, key: list[str], size: int, after: tuple | None = None) -> tuple[DataFrame, tuple | None]:
    """One page of a delta in key order behind a key, and the key that the next page begins behind (None: the last)."""
    behind, same = F.lit(after is None), F.lit(True)
    for k, v in zip(key, after or (), strict=False):
        behind |= same & (c(k) > F.lit(v))
        same &= c(k) == F.lit(v)
    rows = changes.where(behind).orderBy(*[c(k) for k in key]).limit(size + 1).collect()  # one page
    page = changes.sparkSession.createDataFrame(rows[:size], changes.schema)
    return page, tuple(rows[size - 1][k] for k in key) if len(rows) > size else None


def replay(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with net changes applied: what a client holds after following a delta."""
    names = [x for x in base.columns if x not in key]
    kept = base.join(changes.select(*[c(k) for k in key]), key, "left_anti")
    new = changes.where("_change <> 'deleted'").select(*[c(k) for k in key], *[c(n) for n in names])
    return kept.select(*[c(k) for k in key], *[c(n) for n in names]).unionByName(new)


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))
