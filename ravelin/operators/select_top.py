"""topcount, topsum, toppercent and their bottom kin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.errors import bad
from ravelin.operators.frame import Frame, c, fresh
from ravelin.operators.hierarchy import _cut
from ravelin.plans.tree import Node

#: Rows of one slice of an order; each slice is a window of its own.
PER_SLICE = 200_000


def sliced(df: DataFrame, order: list[Column], rows_per_slice: int) -> tuple[DataFrame, str]:
    """Adds the number of the slice of the order that a row is in: as many slices as the rows need.

    Ranges are cut by value and key together, so rows of one value are cut too.
    They are written once, since ranges that are sampled again could differ.
    """
    slot = fresh("slot")
    n = -(-df.count() // rows_per_slice)
    if n <= 1:
        return df.withColumn(slot, F.lit(0)), slot
    return _cut(df.repartitionByRange(n, *order).withColumn(slot, F.spark_partition_id())), slot


def ordered_prefix(df: DataFrame, value: Column, descending: bool, ties: list[str], partition: list[str], rows_per_slice: int = PER_SLICE) -> tuple[DataFrame, str, str]:
    """Adds, in value order, the highest sum before each row, and the total.

    Sums of slices run over a few rows, and each slice is a window of its own,
    so that no task sorts all rows. With ``partition`` each group is a window.
    """
    v, before, total = fresh("v"), fresh("before"), fresh("total")
    rows = df.withColumn(v, value).where(c(v).isNotNull())
    order = [c(v).desc() if descending else c(v).asc(), *[c(t).asc() for t in ties]]
    if partition:
        w = Window.partitionBy(*[c(p) for p in partition])
        run = F.sum(c(v)).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(before, run - c(v)).withColumn(total, F.sum(c(v)).over(w))
        high = F.max(c(before)).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(before, high), before, total
    at, own = fresh("at"), fresh("own")
    rows, slot = sliced(rows, order, rows_per_slice)
    inside = Window.partitionBy(c(slot)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(own, F.sum(c(v)).over(inside) - c(v)).withColumn(at, F.max(c(own)).over(inside))
    slices = rows.groupBy(c(slot).alias("s")).agg(F.sum(c(v)).alias("sum"), F.max(c(own)).alias("peak"))
    up = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("sum").over(up), F.lit(0).cast(rows.schema[v].dataType)))
    slices = slices.withColumn("peak", F.max(F.col("base") + F.col("peak")).over(up)).withColumn("all", F.sum("sum").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    side = slices.select(F.col("s").alias(f"{slot}s"), F.col("base").alias(f"{slot}b"), F.col("peak").alias(f"{slot}p"), F.col("all").alias(total))
    rows = rows.join(F.broadcast(side), c(slot) == c(f"{slot}s"), "inner")  # one row a slice
    high = F.greatest(c(f"{slot}b") + c(at), c(f"{slot}p"))
    return rows.withColumn(before, high), before, total


def best(frame: Frame, kind: str, amount: Node, by: Node) -> Frame:
    """The rows that topcount(n,e) and the others leave."""
    frame = frame.copy()
    frame.these = frame.df
    descending = kind.startswith("top")
    n = frame.compile(amount)
    value = frame.compile(by)
    if frame.type_of(value).partition("(")[0] not in ("tinyint", "smallint", "int", "bigint", "decimal", "float", "double"):
        raise bad(f"{kind} needs a number")
    ties = frame.keys()
    order = [value.desc() if descending else value.asc(), *[c(t).asc() for t in ties]]
    keep = list(frame.df.columns)
    if kind.endswith("count"):
        rows = frame.df.where(value.isNotNull())
        from ravelin.plans.tree import Literal

        if not frame.partition and isinstance(amount, Literal):
            return frame.with_df(rows.orderBy(*order).limit(int(amount.value)))  # type: ignore[call-overload]
        place = fresh("place")
        if frame.partition:
            rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(*[c(p) for p in frame.partition]).orderBy(*order)))
            return frame.with_df(rows.where(c(place) <= F.floor(n)).select(*[c(k) for k in keep]))
        first = rows.withColumn(fresh("n"), F.lit(1))
        counted, before, _ = ordered_rank(first, value, descending, ties)
        return frame.with_df(counted.where(c(before) < F.floor(n)).select(*[c(k) for k in keep]))
    rows, before, total = ordered_prefix(frame.df, value, descending, ties, frame.partition)
    goal = n if kind.endswith("sum") else c(total) * n / 100
    return frame.with_df(rows.where(c(before) < goal).select(*[c(k) for k in keep]))


def ordered_rank(df: DataFrame, value: Column, descending: bool, ties: list[str], rows_per_slice: int = PER_SLICE) -> tuple[DataFrame, str, str]:
    """Adds the number of rows before each one, slice by slice as above."""
    v, own, before = fresh("v"), fresh("own"), fresh("before")
    order = [c(v).desc() if descending else c(v).asc(), *[c(t).asc() for t in ties]]
    rows, slot = sliced(df.withColumn(v, value), order, rows_per_slice)
    rows = rows.withColumn(own, F.row_number().over(Window.partitionBy(c(slot)).orderBy(*order)) - 1)
    slices = rows.groupBy(c(slot).alias(f"{slot}s")).agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy(c(f"{slot}s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(slices.withColumn(f"{slot}b", base).drop("n")), c(slot) == c(f"{slot}s"), "inner")  # one row a slice
    return rows.withColumn(before, c(f"{slot}b") + c(own)), before, slot
