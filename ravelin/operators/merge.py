"""Offline sync: conflict rules as columns of one three-way join, version vectors and clocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.errors import bad
from ravelin.operators.frame import c

RULES = ("remote", "local", "last_writer", "fields")


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: list[str], rule: str = "fields", fallback: str = "remote", stamp: str | None = None, peers: bool = False, field_rules: dict[str, str] | None = None, attributes: dict[str, Callable[[Column, Column, Column], Column]] | None = None) -> DataFrame:
    """One row per object: the values after the merge and ``_outcome``.

    Outcomes: same, remote, local, merged, conflict (resolved by the rule) and
    deleted. ``last_writer`` compares stamps; of equal stamps the remote's row
    wins, or between peers the larger fingerprint, so that both sides agree.
    ``fields`` takes each field from the side that changed it, and falls back
    where both did: to the field's own rule of ``field_rules``, else to
    ``fallback``. ``attributes`` merge a field of both sides' values by a
    function of base, local and remote (``counter``, ``members``), in any rule.
    """
    if rule not in RULES or fallback not in RULES or (("last_writer" in (rule, fallback)) and stamp is None):
        raise bad(f"no such rule, or no stamp: {rule}, {fallback}")
    names = [x for x in local.columns if x not in key]
    side = lambda df, tag: df.select(*[c(k) for k in key], F.struct(*[c(n) for n in names]).alias(tag))
    rows = side(base, "b").join(side(local, "l"), key, "full_outer").join(side(remote, "r"), key, "full_outer")
    b, mine, theirs = F.col("b"), F.col("l"), F.col("r")
    changed_l, changed_r = ~mine.eqNullSafe(b), ~theirs.eqNullSafe(b)
    prints = lambda s: F.sha2(F.coalesce(F.to_json(s), F.lit("")), 256)

    def newer() -> Column:
        """Whether the local side wins by its stamp."""
        x, y = mine.getField(stamp), theirs.getField(stamp)  # type: ignore[arg-type]
        tie = prints(mine) > prints(theirs) if peers else F.lit(False)
        return F.when(mine.isNull(), False).when(theirs.isNull(), True).when(x.eqNullSafe(y), tie).when(y.isNull(), True).when(x.isNull(), False).otherwise(x > y)

    def whole(name: str) -> Column:
        return {"remote": theirs, "local": mine, "last_writer": F.when(newer(), mine).otherwise(theirs)}[name]

    def by_fields() -> Column:
        last = whole(fallback if fallback != "fields" else "remote")
        out = []
        for n in names:
            x, y, z = mine.getField(n), theirs.getField(n), b.getField(n)
            both = ~x.eqNullSafe(z) & ~y.eqNullSafe(z) & ~x.eqNullSafe(y)
            won = whole(field_rules[n]) if n in (field_rules or {}) else last
            out.append(F.when(both, won.getField(n)).when(~x.eqNullSafe(z), x).otherwise(y).alias(n))
        if stamp is not None:
            k = names.index(stamp)
            out[k] = F.greatest(mine.getField(stamp), theirs.getField(stamp)).alias(stamp)
        # A deletion against a change can't be merged by fields.
        return F.when(mine.isNull() | theirs.isNull(), whole(fallback if fallback != "fields" else "remote")).otherwise(F.struct(*out))

    conflict = changed_l & changed_r & ~mine.eqNullSafe(theirs)
    resolved = by_fields() if rule == "fields" else whole(rule)
    if attributes:
        alive = mine.isNotNull() & theirs.isNotNull()
        resolved = F.when(alive & resolved.isNotNull(), F.struct(*[(attributes[n](b.getField(n), mine.getField(n), theirs.getField(n)) if n in attributes else resolved.getField(n)).alias(n) for n in names])).otherwise(resolved)
    value = F.when(conflict, resolved).when(changed_l, mine).otherwise(theirs)
    rows = rows.withColumn("__v", value).withColumn(
        "_outcome",
        F.when(value.isNull(), "deleted").when(conflict, F.lit("merged" if rule == "fields" else "conflict")).when(changed_l & changed_r, "same").when(changed_l, "local").when(changed_r, "remote").otherwise("same"),
    )
    return rows.select(*[c(k) for k in key], *[F.col("__v").getField(n).alias(n) for n in names], "_outcome")


def counter(base: Column, mine: Column, theirs: Column) -> Column:
    """Both sides' increments."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return zero(mine) + zero(theirs) - zero(base)


def members(base: Column, mine: Column, theirs: Column) -> Column:
    """A set: what either side added, without what either removed."""
    have = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    gone = F.array_union(F.array_except(have(base), have(mine)), F.array_except(have(base), have(theirs)))
    return F.array_sort(F.array_except(F.array_union(have(mine), have(theirs)), gone))


# --- version vectors: map<string,long> ---


def parse_vector(text: Column) -> Column:
    """``a:1,b:2`` as a map; empty text is the empty vector."""
    pairs = F.filter(F.split(text, ","), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).alias("key"), F.split_part(p, F.lit(":"), F.lit(2)).cast("long").alias("value"))))


def merge_vectors(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compare_vectors(a: Column, b: Column) -> Column:
    """same, before, after or concurrent."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    more, less = F.exists(both, lambda d: d > 0), F.exists(both, lambda d: d < 0)
    return F.when(more & less, "concurrent").when(more, "after").when(less, "before").otherwise("same")


def vector_text(v: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(v)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


# --- hybrid logical clock ---


@dataclass
class Clock:
    """Stamps ``<ms, 16 digits>.<counter, 4>.<replica, 8>`` that compare as texts."""

    replica: str
    last: tuple[int, int] = (0, 0)

    def tick(self, now_ms: int) -> str:
        ms, n = self.last
        self.last = (now_ms, 0) if now_ms > ms else (ms, n + 1)
        return self.text()

    def receive(self, stamp: str, now_ms: int) -> None:
        ms, n, _ = stamp.split(".")
        self.last = max(self.last, (int(ms), int(n)), (now_ms, 0))

    def text(self) -> str:
        return f"{self.last[0]:016d}.{self.last[1]:04d}.{self.replica[:8]:>08}"


# --- tombstones and full reconciliation ---


def reconcile(local_keys: DataFrame, remote_keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys that only one side has: (to delete here, to fetch)."""
    return local_keys.join(remote_keys, key, "left_anti"), remote_keys.join(local_keys, key, "left_anti")


def without_tombstones(rows: DataFrame, tombstones: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*[c(k) for k in key]), key, "left_anti")


def prune_tombstones(tombstones: DataFrame, oldest: Column, at: str = "deleted_at") -> DataFrame:
    return tombstones.where(c(at) >= oldest)


def sync_round(base: DataFrame, local: DataFrame, remote: DataFrame, key: list[str], **rule) -> dict[str, DataFrame]:
    """One round: the merged state, what to upload and what to download."""
    merged = three_way(base, local, remote, key, **rule)
    alive = merged.where("_outcome <> 'deleted'").drop("_outcome")
    return {"state": alive, "upload": alive.exceptAll(remote.select(alive.columns)), "download": alive.exceptAll(local.select(alive.columns)), "outcomes": merged.select(*[c(k) for k in key], "_outcome")}
