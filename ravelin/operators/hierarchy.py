"""Recursive hierarchies: closures by frontier joins, tests, and traversal in tree order."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.errors import bad, unsupported
from ravelin.operators.frame import Frame, c, fresh
from ravelin.plans.tree import Literal, Node, Order, Path
from ravelin.sources.model import EntitySet, Hierarchy


def find(frame: Frame, set_name: str, qualifier: str) -> tuple[EntitySet, Hierarchy]:
    entity = frame.ctx.model.set(set_name)
    h = entity.hierarchies.get(qualifier)
    if h is None:
        raise bad(f"{set_name} has no hierarchy {qualifier}")
    return entity, h


def edges(frame: Frame, entity: EntitySet, h: Hierarchy) -> tuple[DataFrame, DataFrame]:
    """Nodes (node) and edges (node, parent) among the rows that are visible: a parent outside is none."""
    rows = frame.ctx.rows(entity)
    nodes = rows.select(c(h.node).alias("node")).where("node IS NOT NULL").distinct()
    pairs = h.edges(frame.ctx.spark).toDF("node", "parent") if h.edges else rows.select(c(h.node).alias("node"), c(h.parent or "").alias("parent"))
    pairs = pairs.where("node IS NOT NULL AND parent IS NOT NULL").distinct()
    known = nodes.select(F.col("node").alias("parent"))
    return nodes, pairs.join(known, "parent", "left_semi").join(nodes, "node", "left_semi").select("node", "parent")


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a round in the folder that all executors share."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="ravelin-")  # one machine: its folders are shared
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/ravelin-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def reach_any(start: DataFrame, pairs: DataFrame, up: bool, deepest: int | None) -> DataFrame:
    """(node, distance) reached from any start: one row a node, which is all that a semi-join needs."""
    step = pairs.select(F.col("node").alias("from"), F.col("parent").alias("to")) if up else pairs.select(F.col("parent").alias("from"), F.col("node").alias("to"))
    seen = _cut(start.select("node").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for turn in count(1) if deepest is None else range(1, deepest + 1):
        new = frontier.join(step, frontier["node"] == step["from"]).select(F.col("to").alias("node")).distinct()
        new = _cut(new.join(seen, "node", "left_anti").withColumn("distance", F.lit(turn)))
        if new.isEmpty():
            break
        frontier, seen = new, seen.unionByName(new)
    return seen


def related(frame: Frame, kind: str, args: tuple, run) -> Frame:
    """ancestors(...) and descendants(...): input rows whose node is reached from the nodes of T's rows."""
    root, qualifier, node, start, depth, keep = args
    entity, h = find(frame, root, qualifier)
    _, pairs = edges(frame, entity, h)
    frame = frame.copy()
    own = fresh("node")
    frame.df = frame.df.withColumn(own, frame.value(node))
    from_rows = run(frame, start)
    reached = reach_any(from_rows.df.select(c(own).alias("node")).where("node IS NOT NULL"), pairs, kind == "ancestors", depth)
    wanted = reached if keep else reached.where("distance > 0")
    return frame.with_df(frame.df.join(wanted.select(F.col("node").alias(own)), own, "left_semi"))


def traverse(frame: Frame, args: tuple) -> Frame:
    """Rows in tree order. Siblings and roots are sorted by ``orders``, else by the key."""
    root, qualifier, node, order, orders = args
    entity, h = find(frame, root, qualifier)
    if h.edges is not None:
        raise unsupported("traverse with several parents")
    spot = place(frame, entity, h, orders)
    frame = frame.copy()
    own = fresh("node")
    frame.df = frame.df.withColumn(own, frame.value(node))
    rows = frame.df.join(spot.select(F.col("node").alias(own), "path"), own, "inner")
    path = F.col("path")
    if order == "postorder":  # children first: a path's end sorts after all that goes on
        path = F.concat(path, F.array(F.lit(2**62)))
    rank = fresh("order")
    frame.df = rows.withColumn(rank, path).drop("path")
    frame.order = [(c(rank), False), *[(c(k), False) for k in frame.keys()]]
    frame.df = frame.df.orderBy(*[x.asc() for x, _ in frame.order])
    return frame


def place(frame: Frame, entity: EntitySet, h: Hierarchy, orders: tuple[Order, ...]) -> DataFrame:
    """(node, path): ranks among siblings from the root down. Nodes on cycles have no root and no place."""
    side = Frame.of(frame.ctx, entity)
    by: list[Column] = []
    for o in orders:
        e = side.compile(o.expression)
        by.append(e.desc() if o.descending else e.asc())
    by += [c(k).asc() for k in entity.key]
    known = side.df.select(c(h.node).alias("__known")).distinct()
    rows = side.df.join(known, c(h.parent or "") == F.col("__known"), "left")
    siblings = Window.partitionBy("__known").orderBy(*by)
    rows = rows.where(c(h.node).isNotNull()).select(c(h.node).alias("node"), F.col("__known").alias("parent"), F.row_number().over(siblings).cast("long").alias("rank"))
    rows = _cut(rows)
    level = _cut(rows.where("parent IS NULL").select("node", F.array("rank").alias("path")))
    found = level
    while True:  # nodes on cycles have no root, so paths end
        below = rows.join(level.select(F.col("node").alias("parent"), "path"), "parent").select("node", F.concat("path", F.array("rank")).alias("path"))
        level = _cut(below)
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def hierarchy_test(frame: Frame, name: str, named: dict[str, Node]) -> Column:
    """isnode, isroot, isleaf, isancestor, isdescendant, issibling as a condition on rows."""
    nodes_at, qualifier, node = named.get("HierarchyNodes"), named.get("HierarchyQualifier"), named.get("Node")
    if not isinstance(nodes_at, Path) or nodes_at.segments[0] != "$root" or not isinstance(qualifier, Literal) or node is None:
        raise bad(f"{name} needs HierarchyNodes, HierarchyQualifier and Node")
    entity, h = find(frame, nodes_at.segments[1], str(qualifier.value))
    nodes, pairs = edges(frame, entity, h)
    other = {"isancestor": "Descendant", "isdescendant": "Ancestor", "issibling": "Other"}.get(name)
    if name == "isnode":
        found = nodes
    elif name == "isroot":
        found = nodes.join(pairs, "node", "left_anti")
    elif name == "isleaf":
        found = nodes.join(pairs.select(F.col("parent").alias("node")), "node", "left_anti")
    else:
        end = named.get(other or "")
        if not isinstance(end, Literal):
            raise unsupported(f"{name} with other than a literal {other}")
        one = nodes.where(F.col("node") == F.lit(end.value))
        if name == "issibling":
            mine = one.join(pairs, "node", "left").select("parent")
            sharing = pairs.join(mine.where("parent IS NOT NULL"), "parent", "left_semi").select("node")
            roots = nodes.join(pairs, "node", "left_anti").join(mine.where("parent IS NULL").limit(1), F.lit(True), "left_semi")
            found = sharing.union(roots).where(F.col("node") != F.lit(end.value))
        else:
            most, itself = named.get("MaxDistance"), named.get("IncludeSelf")
            found = reach_any(one, pairs, name == "isancestor", int(most.value) if isinstance(most, Literal) else None)  # type: ignore[call-overload]
            if not (isinstance(itself, Literal) and itself.value):
                found = found.where("distance > 0")
    mark, key = fresh("is"), fresh("key")
    value = frame.compile(node)
    own = fresh("node")
    frame.df = frame.df.withColumn(own, value).join(found.select(F.col("node").alias(key)).distinct().withColumn(mark, F.lit(True)), c(own) == c(key), "left").drop(key)
    return F.when(c(own).isNotNull(), F.coalesce(c(mark), F.lit(False)))
