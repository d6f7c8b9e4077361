"""Writes planned as DataFrames: read, check, write, and one atomic publication.

A write never changes a table in place. It makes the set's next version; a
``Store`` writes it to a new folder and swaps a pointer, so that readers see
either all of a change set or nothing of it.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.errors import QueryError, bad, unsupported
from ravelin.operators.changes import row_hash
from ravelin.operators.frame import c
from ravelin.sources.model import EntitySet


def same_key(key: Sequence[str], values: dict) -> Column:
    return functools.reduce(lambda a, b: a & b, [c(k) == F.lit(values[k]) for k in key])


def generated_keys(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows with ``max + 1, max + 2, ...`` where the key is null, above the keys given too."""
    top = df.agg(F.max(c(key)).alias("a")).crossJoin(new.agg(F.max(c(key)).alias("b")))  # one row
    rest = [x for x in new.columns if x != key]
    numbered = new.where(c(key).isNull()).withColumn("__n", F.row_number().over(Window.orderBy(*[c(x) for x in rest])))  # rows of one request
    given = numbered.crossJoin(F.broadcast(top)).withColumn(key, (F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))) + F.col("__n")).cast(df.schema[key].dataType))
    return new.where(c(key).isNotNull()).unionByName(given.select(*new.columns))


def insert(df: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds rows; columns that are not given are null. Taken keys fail before anything is written."""
    if len(key) == 1:
        new = generated_keys(df, new, key[0])
    if not new.join(df, list(key), "left_semi").isEmpty() or new.groupBy(*[c(k) for k in key]).count().where("count > 1").limit(1).count():
        raise QueryError(409, "the key is taken")
    return df.unionByName(new.select(*[c(x) for x in new.columns if x in df.columns]), allowMissingColumns=True).select(*df.columns)


def update(df: DataFrame, condition: Column, values: dict[str, object], key: Sequence[str] = (), immutable: Sequence[str] = ()) -> DataFrame:
    """PATCH: changes the given properties of the rows that match. Values may be Columns."""
    for name in values:
        if name not in df.columns:
            raise bad(f"no property {name}")
        if name in key or name in immutable:
            raise bad(f"{name} can't be changed")
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(c(n)).cast(df.schema[n].dataType).alias(n) if (v := values.get(n, _KEEP)) is not _KEEP else c(n) for n in df.columns])


_KEEP = object()


def replace(df: DataFrame, condition: Column, values: dict[str, object], key: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """PUT: properties that are not given get their defaults."""
    whole = {n: (defaults or {}).get(n) for n in df.columns if n not in key} | values
    return update(df, condition, whole, key)


def delete(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Merge: rows whose key is known are updated in the columns given, others inserted."""
    given = [x for x in rows.columns if x not in key]
    a = df.select(*[c(k) for k in key], F.struct(*[c(n) for n in df.columns if n not in key]).alias("__a"))
    b = rows.select(*[c(k) for k in key], F.struct(*[c(n) for n in given]).alias("__b"))
    both = a.join(b, list(key), "full_outer")
    out = [F.when(F.col("__b").isNotNull(), F.col("__b").getField(n)).otherwise(F.col("__a").getField(n)).cast(df.schema[n].dataType).alias(n) if n in given else F.col("__a").getField(n).alias(n) for n in df.columns if n not in key]
    return both.select(*[c(k) for k in key], *out).select(*df.columns)


def delta_payload(df: DataFrame, rows: DataFrame, removed: DataFrame, key: Sequence[str]) -> DataFrame:
    """A delta: removed keys go, the rest is merged."""
    return upsert(df.join(removed.select(*[c(k) for k in key]), list(key), "left_anti"), rows, key)


def link(bridge: DataFrame, rows: DataFrame) -> DataFrame:
    return bridge.unionByName(rows.select(bridge.columns)).distinct()


def unlink(bridge: DataFrame, rows: DataFrame) -> DataFrame:
    return bridge.join(rows, list(rows.columns), "left_anti")


def check_references(rows: DataFrame, column: str, target: DataFrame, target_key: str) -> None:
    """400 if a row refers to what is not there; before any write."""
    there = target.select(c(target_key).alias(column))
    if not rows.where(c(column).isNotNull()).join(there, column, "left_anti").isEmpty():
        raise bad(f"{column} refers to what does not exist")


def deep_insert(parents: DataFrame, children: DataFrame, new_parents: DataFrame, new_children: DataFrame, key: str, child_key: str, foreign: str, tag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parents with their children: both versions, the children bound to their parent's (perhaps generated) key.

    ``tag`` names a column that tells which new parent a new child belongs to;
    without it there must be one parent. Children that no parent has fail, and a
    child that names a ``foreign`` key of its own is bound to that (``@odata.bind``).
    """
    if tag is None:
        if new_parents.limit(2).count() != 1:
            raise bad("children of several parents need a tag")
        new_parents, new_children, tag = new_parents.withColumn("__tag", F.lit(0)), new_children.withColumn("__tag", F.lit(0)), "__tag"
    keyed = generated_keys(parents, new_parents, key)
    if not new_children.join(keyed, tag, "left_anti").isEmpty():
        raise bad("a child without its parent")
    own = c(foreign) if foreign in new_children.columns else F.lit(None)
    bound = new_children.withColumn("__own", own).drop(foreign).join(keyed.select(tag, c(key).alias("__key")), tag).withColumn(foreign, F.coalesce("__own", "__key")).drop(tag, "__own", "__key")
    return insert(parents, keyed.drop(tag), (key,)), insert(children, bound, (child_key,))


def etag(columns: Sequence[str]) -> Column:
    return F.concat(F.lit('W/"'), F.substring(row_hash(list(columns)), 1, 16), F.lit('"'))


def check_etag(df: DataFrame, condition: Column, columns: Sequence[str], expected: str) -> None:
    found = df.where(condition).select(etag(columns)).limit(1).collect()
    if not found:
        raise QueryError(404, "no such row")
    if expected != "*" and found[0][0] != expected:
        raise QueryError(412, "the row was changed meanwhile")


# --- validation ---


@dataclass(frozen=True)
class Rule:
    """A named condition that every written row must meet (null: met)."""

    name: str
    condition: Column


def multiple_of(column: str, n: object) -> Rule:
    return Rule(f"{column} must be a multiple of {n}", F.try_mod(c(column), F.lit(n)) == 0)


def in_range(column: str, least: object = None, most: object = None) -> Rule:
    test = F.lit(True)
    if least is not None:
        test &= c(column) >= F.lit(least)
    if most is not None:
        test &= c(column) <= F.lit(most)
    return Rule(f"{column} must be within {least} and {most}", test)


def matching(column: str, pattern: str) -> Rule:
    from ravelin.functions.patterns import to_java

    return Rule(f"{column} must match {pattern}", F.rlike(c(column), F.lit(to_java(pattern))))


def rules_of(entity: EntitySet) -> list[Rule]:
    """The rules that a model's validation terms state for a set's properties."""
    out = []
    for column, terms in entity.validation.items():
        for term, value in terms.items():
            match term:
                case "Minimum" | "Maximum":
                    exclusive = bool(terms.get(f"{term}Exclusive"))
                    low = term == "Minimum"
                    test = (c(column) > F.lit(value) if exclusive else c(column) >= F.lit(value)) if low else (c(column) < F.lit(value) if exclusive else c(column) <= F.lit(value))
                    out.append(Rule(f"{column} must be {'above' if low else 'below'} {value}", test))
                case "MinimumExclusive" | "MaximumExclusive":
                    continue
                case "Pattern":
                    out.append(matching(column, str(value)))
                case "AllowedValues":
                    out.append(Rule(f"{column} must be one of {value}", c(column).isin(*value)))  # type: ignore[misc]
                case "MultipleOf":
                    out.append(multiple_of(column, value))
                case "MaxLength":
                    out.append(Rule(f"{column} must have at most {value} characters", F.length(c(column)) <= value))
                case "MinItems":
                    out.append(Rule(f"{column} must have at least {value} members", F.size(c(column)) >= value))
                case "MaxItems":
                    out.append(Rule(f"{column} must have at most {value} members", F.size(c(column)) <= value))
                case "Required":
                    if value:
                        out.append(Rule(f"{column} must be given", c(column).isNotNull()))
                case _:
                    raise unsupported(f"the validation term {term}")
    return out


def validate(rows: DataFrame, rules: Sequence[Rule]) -> None:
    """400 with the details of each rule that some row breaks; one pass over the rows."""
    if not rules:
        return
    broken = rows.agg(*[F.count_if(~F.coalesce(r.condition, F.lit(True))).alias(f"r{k}") for k, r in enumerate(rules)]).collect()[0]
    details = [f"{r.name} ({broken[k]} rows)" for k, r in enumerate(rules) if broken[k]]
    if details:
        raise bad("; ".join(details))


# --- publication ---


@dataclass
class Store:
    """Versions of sets in a folder; a small pointer file names the current one of each."""

    spark: SparkSession
    root: str
    staged: dict[str, str] = field(default_factory=dict)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p, jvm

    def pointers(self) -> dict[str, str]:
        fs, path, _ = self._fs(f"{self.root}/current.json")
        if not fs.exists(path):
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/current.json").collect()))

    def read(self, name: str) -> DataFrame:
        at = self.pointers().get(name)
        if at is None:
            raise QueryError(404, f"no set {name}")
        return self.spark.read.parquet(f"{self.root}/{at}")

    def stage(self, name: str, df: DataFrame) -> None:
        at = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{at}")
        self.staged[name] = at

    def publish(self) -> None:
        """All staged versions become current by one rename."""
        pointers = self.pointers() | self.staged
        fs, final, jvm = self._fs(f"{self.root}/current.json")
        _, fresh, _ = self._fs(f"{self.root}/current-{uuid.uuid4().hex}.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(pointers).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        # One step: readers see the old pointer or the new one. It raises where it fails.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, final, options)
        self.staged = {}

    def change_set(self, operations: Sequence[Callable[[Store], None]]) -> None:
        """All or nothing: an error leaves what readers see as it was."""
        try:
            for operation in operations:
                operation(self)
        except Exception:
            self.staged = {}
            raise
        self.publish()
