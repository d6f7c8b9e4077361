"""Approximate nearest neighbours: NN-descent builds a graph, greedy search answers queries.

1. Vectors that are equal become one node (its smallest ids stand for it), so a
   vector that a third of all rows have is one node, not a clique of zero
   distances.
2. A first graph comes from ``TREES`` random trees of hyperplanes, fitted on a
   sample of about ``SAMPLE`` vectors (that bound is all that is sampled: every
   row is dealt to a leaf and indexed). Leaves, cut along a direction where they
   are large, make blocks of bounded size that are searched exactly.
3. NN-descent: joins bring each node its ``DEGREE`` neighbours and the
   ``REVERSE`` closest of those that link to it, with their vectors. All pairs
   of that bounded list of which one is new propose links, and each node keeps
   its best ``DEGREE``; a pair farther than the worst link that its node has is
   left out. Rounds go on until the share of new links is at most ``SETTLED``,
   however many that takes. Distances here are of half-precision copies.
4. Queries start at their own node. In each step all nodes of a beam that are
   not yet expanded are, through the graph by joins; the search ends when no
   beam changes, and not before.

Queries rank all candidates met by Euclidean distances in double precision on
the original vectors. Vectors that are null, zero, of another length than most,
or hold null or non-finite components take no part, nor do rows without an id.
Rows that share an id answer and are found under it with the least distance of
their vectors. Ties go to the smaller id. An empty table, or one with a single
vector, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.lake import Scratch, fits_broadcast

NEAREST = 10
DEGREE = 24
REVERSE = 24
#: Trees of the first graph, vectors that they are fitted on, nodes of a block.
TREES, SAMPLE, BLOCK = 5, 20_000, 384
#: Descents end when at most this share of the links is new in one.
SETTLED = 0.005
BEAM = 128


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    width_of = dict(embeddings.dtypes)[vector]
    exact = width_of if width_of == "array<float>" else "array<double>"  # floats stay floats where they are moved
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), v.cast(exact).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("v") == (width["w"] if width else 0))


def distinct_nodes(rows: DataFrame, scratch: Scratch, least: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, v) and members (node, vec_id, nth): of equal vectors the ``least`` smallest ids."""
    hashed = rows.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(7), "v"))
    nodes = scratch.keep(hashed.groupBy("a", "b").agg(F.min("vec_id").alias("node"), F.min_by("v", "vec_id").alias("v")), "nodes")
    own = hashed.join(nodes.select("a", "b", "node"), ["a", "b"]).select("node", "vec_id").distinct()
    # The smallest ids of a group: first of each slice of it, then of all.
    part = own.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    some = part.withColumn("nth", F.row_number().over(Window.partitionBy("node", "slice").orderBy("vec_id"))).where(F.col("nth") <= least)
    nth = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    members = scratch.keep(some.select("node", "vec_id").withColumn("nth", nth).where(F.col("nth") <= least), "members")
    return nodes.select("node", "v"), members


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _codes(column: pa.Array) -> np.ndarray:
    """Half-precision vectors of a binary column."""
    size = column[0].as_buffer().size // 2
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), size)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


LINK = "node long, other long, d float"
#: A node of the graph: its vector's copy, its links by distance, which of them are new, and its worst distance (infinite: it takes any).
STATE = "node long, code binary, others array<long>, ds array<float>, fresh array<boolean>, reach float"


def _links(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float32())], ["node", "other", "d"])


def fitted_trees(sample: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree the hyperplanes (in heap order) and their offsets, at medians of the sample."""
    rng = np.random.default_rng(17)
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / BLOCK)))), int(np.log2(max(1, len(sample) / 16)))))
    trees = []
    for _ in range(TREES):
        width = sample.shape[1] if sample.size else 1
        planes, offsets = np.zeros((2**depth - 1, width), np.float32), np.zeros(2**depth - 1, np.float32)
        own = np.zeros(len(sample), np.int64)  # place of each sampled vector in the heap
        for k in range(2**depth - 1):
            rows = np.flatnonzero(own == k)
            if len(rows) > 1:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                planes[k] = a - b if (a != b).any() else rng.normal(size=width)
                along = sample[rows] @ planes[k]
                offsets[k] = np.median(along)
                own[rows] = 2 * k + 1 + (along > offsets[k])
        trees.append((planes, offsets))
    return trees


def leaves(nodes: DataFrame, trees: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(tree, leaf, place, node, code): each node's leaf in each tree, and its place along a direction."""
    shared = nodes.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _codes(batch.column("code")).astype(np.float32)
            for t, (planes, offsets) in enumerate(shared.value):
                at = np.zeros(len(m), np.int64)
                for _ in range(int(np.log2(len(planes) + 1))):
                    at = 2 * at + 1 + ((m * planes[at]).sum(axis=1) > offsets[at])
                direction = np.random.default_rng(100 + t).normal(size=m.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(at), pa.array(m @ direction), batch.column("node"), batch.column("code")], ["tree", "leaf", "place", "node", "code"])

    return nodes.select("node", "code").mapInArrow(work, "tree int, leaf long, place double, node long, code binary")


def block_links(nodes: DataFrame, n: int, degree: int) -> DataFrame:
    """Exact links within blocks of the trees' leaves."""
    rows = nodes.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)))).select("code").toArrow()["code"].combine_chunks()
    sample = _codes(rows).astype(np.float32) if len(rows) else np.zeros((0, 1), np.float32)
    dealt = leaves(nodes, fitted_trees(sample, n)).repartitionByRange(max(1, TREES * n // (16 * BLOCK)), "tree", "leaf", "place").sortWithinPartitions("tree", "leaf", "place")

    def work(batches):
        keys, ids, rows = [], [], []
        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column("tree").to_numpy().astype(np.int64) << 32 | batch.column("leaf").to_numpy())
                ids.append(batch.column("node").to_numpy())
                rows.append(_codes(batch.column("code")))
        if not ids:
            return
        keys, ids, m = np.concatenate(keys), np.concatenate(ids), np.concatenate(rows)
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            parts = -(-(b - a) // (2 * BLOCK))
            for part in np.array_split(np.arange(a, b), parts):
                if len(part) < 2:
                    continue
                own, x = ids[part], m[part].astype(np.float32)
                d = _squared(x, x)
                np.fill_diagonal(d, np.inf)
                k = min(degree, len(part) - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield _links(np.repeat(own, k), own[near].ravel(), np.take_along_axis(d, near, 1).ravel())

    return dealt.mapInArrow(work, LINK)


def merged(state: DataFrame, links: DataFrame, degree: int) -> DataFrame:
    """The state after links were proposed: each node's ``degree`` closest."""
    known = state.select("node", F.lit(-1).cast("long").alias("other"), F.lit(-1.0).cast("float").alias("d"), "code", "others", "ds")
    proposed = links.select("node", "other", "d", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<long>").alias("others"), F.lit(None).cast("array<float>").alias("ds"))

    def work(batches):
        # Sorted by node and distance: a node's own row comes first, then its proposals, which may go on in the next batch.
        open_row: list | None = None  # node, code, known links, and proposals so far (others, distances)

        def closed(rows: list[list]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], []]
            for node, code, others, ds, new, new_d in rows:
                have = set(others)
                near = [*zip(ds, others, [False] * len(others), strict=True)]
                for o, x in zip(new, new_d, strict=True):
                    if o not in have:
                        have.add(o)
                        near.append((x, o, True))
                near = sorted(near)[:degree]
                for column, value in zip(out, (node, code, [o for _, o, _ in near], [x for x, _, _ in near], [f for _, _, f in near], near[-1][0] if len(near) >= degree else float("inf")), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.float32())), pa.array(out[4], pa.list_(pa.bool_())), pa.array(out[5], pa.float32())], ["node", "code", "others", "ds", "fresh", "reach"])

        for batch in batches:
            node, other, d = (batch.column(i).to_numpy() for i in range(3))
            own = np.flatnonzero(d < 0)
            edge = np.append(own, len(node)).tolist()
            done = []
            if open_row is not None and edge[0]:
                open_row[4] += other[: edge[0]].tolist()
                open_row[5] += d[: edge[0]].tolist()
            info = batch.select(["code", "others", "ds"]).take(pa.array(own)).to_pydict()
            for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if open_row is not None:
                    done.append(open_row)
                # Proposals come nearest first, each perhaps from several lists: no more than these can matter.
                open_row = [int(node[a]), info["code"][k], info["others"][k] or [], info["ds"][k] or [], other[a + 1 : b].tolist(), d[a + 1 : b].tolist()]
            if open_row is not None and len(open_row[4]) > 64 * degree:
                first = dict(reversed([*zip(open_row[4], open_row[5], strict=True)]))
                nearest = sorted(zip(first.values(), first.keys(), strict=True))[: 2 * degree]
                open_row[4], open_row[5] = [o for _, o in nearest], [x for x, _ in nearest]
            if done:
                yield closed(done)
        if open_row is not None:
            yield closed([open_row])

    return known.unionByName(proposed).repartition("node").sortWithinPartitions("node", "d", "other").mapInArrow(work, STATE)


def in_links(state: DataFrame) -> DataFrame:
    """(node, other, fresh): the ``REVERSE`` closest of those that link to each node."""
    links = state.select(F.col("node").alias("other"), F.explode(F.arrays_zip("others", "ds", "fresh")).alias("x")).select(F.col("x.others").alias("node"), "other", F.col("x.ds").alias("d"), F.col("x.fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("d", "other"))
    return links.withColumn("rank", rank).where(F.col("rank") <= REVERSE).select("node", "other", "fresh")


def proposals(state: DataFrame) -> DataFrame:
    """Links that neighbours of neighbours propose: pairs of each node's list, of which one is new."""
    out = state.select("node", F.explode(F.arrays_zip("others", "fresh")).alias("x")).select("node", F.col("x.others").alias("other"), F.col("x.fresh").alias("fresh"))
    lists = out.unionByName(in_links(state)).join(state.select(F.col("node").alias("other"), "code", "reach"), "other")

    def joined(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Padded lists at once: distances of all pairs within each."""
        most = max(len(x[0]) for x in lists)
        ids, new = np.zeros((len(lists), most), np.int64), np.zeros((len(lists), most), bool)
        there = np.arange(most)[None, :] < np.array([len(x[0]) for x in lists])[:, None]
        reach, m = np.zeros((len(lists), most), np.float32), np.zeros((len(lists), most, lists[0][3].shape[1]), np.float32)
        for k, (i, f, r, v) in enumerate(lists):
            ids[k, : len(i)], new[k, : len(i)], reach[k, : len(i)], m[k, : len(i)] = i, f, r, v
        norm = (m * m).sum(axis=2)
        d = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * m @ m.transpose(0, 2, 1), 0)
        ok = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & (d < reach[:, :, None]) & (ids[:, :, None] != ids[:, None, :])
        k, i, j = np.nonzero(ok)
        a, b, d = ids[k, i], ids[k, j], d[k, i, j]
        turn = np.lexsort((b, a))  # the same pair comes from many lists
        a, b, d = a[turn], b[turn], d[turn]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield _links(a[first], b[first], d[first])

    def work(batches):
        held: list[tuple] = []
        tail = None  # rows of the list that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "other", "fresh", "reach")] + [_codes(batch.column("code"))]
            if tail is not None:
                columns = [np.concatenate((x, y)) for x, y in zip(tail, columns, strict=True)]
            edge = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1]))).tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                _, other, fresh, reach, code = (x[a:b] for x in columns)
                if fresh.any():
                    held.append((other, fresh, reach, code))
                if len(held) == 128:
                    yield from joined(held)
                    held = []
            tail = [x[edge[-1] :] for x in columns]
        if tail is not None and tail[2].any():
            held.append(tuple(tail[1:]))
        if held:
            yield from joined(held)

    # A list has DEGREE + REVERSE rows at most.
    return lists.select("node", "other", "fresh", "reach", "code").repartition("node").sortWithinPartitions("node", "other").mapInArrow(work, LINK)


def build(nodes: DataFrame, scratch: Scratch, degree: int = DEGREE, settled: float = SETTLED) -> DataFrame:
    """The neighbour graph (``STATE``); ``nodes`` (node, v) should be a written table."""
    top = nodes.select(F.array_max(F.transform("v", F.abs)).alias("m")).agg(F.max("m")).first()[0]

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                m = (_matrix(batch.column("v")) / top).astype(np.float16)
                size = m.shape[1] * 2
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(0, size * len(m) + 1, size, dtype=np.int32)), pa.py_buffer(m.tobytes())])], ["node", "code"])

    coded = scratch.keep(nodes.mapInArrow(work, "node long, code binary"), "codes")
    empty = coded.withColumn("others", F.array().cast("array<long>")).withColumn("ds", F.array().cast("array<float>"))
    state = scratch.keep(merged(empty, block_links(coded, nodes.count(), degree), degree), "graph0")
    for turn in count(1):
        state = scratch.keep(merged(state, proposals(state), degree), f"graph{turn}")
        scratch.drop(f"graph{turn - 1}")
        links, new = state.agg(F.sum(F.size("others")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
        if (new or 0) <= settled * (links or 0):
            return state


def search(asked: DataFrame, state: DataFrame, nodes: DataFrame, scratch: Scratch, beam: int = BEAM) -> DataFrame:
    """(query_node, node, d): the beam of each query node after greedy search from its own place; d is squared."""
    edges = state.select("node", F.explode("others").alias("other")).unionByName(in_links(state).select("node", "other"))
    adjacent = scratch.keep(edges.groupBy("node").agg(F.collect_set("other").alias("near")), "adjacent")  # DEGREE + REVERSE at most
    starts = asked.select("query_node").distinct()
    vectors = scratch.keep(nodes.select(F.col("node").alias("query_node"), F.col("v").alias("qv")).join(starts, "query_node", "left_semi"), "asked-vectors")
    asks = vectors.count()
    if fits_broadcast(asks, 600):
        vectors = F.broadcast(vectors)
    found = scratch.keep(starts.select("query_node", F.col("query_node").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("expanded")), "beam0")
    rank = F.row_number().over(Window.partitionBy("query_node").orderBy("d", "node"))

    def work(batches):
        for batch in batches:
            delta = _matrix(batch.column("v")) - _matrix(batch.column("qv"))
            yield pa.RecordBatch.from_arrays([batch.column("query_node"), batch.column("node"), pa.array((delta * delta).sum(axis=1))], ["query_node", "node", "d"])

    for turn in count(1):
        opened = found.where("not expanded").select("query_node", "node")
        if fits_broadcast(asks * beam, 16):
            opened = F.broadcast(opened)
        reached = opened.join(adjacent, "node").select("query_node", F.explode("near").alias("node"))
        known = found.select("query_node", "node", F.lit(1).alias("known")).unionByName(reached.select("query_node", "node", F.lit(0).alias("known")))
        new = scratch.keep(known.groupBy("query_node", "node").agg(F.max("known").alias("known")).where("known = 0").select("query_node", "node"), f"met{turn}")
        few = fits_broadcast(new.count(), 24)
        met = (F.broadcast(new) if few else new).join(nodes, "node").join(vectors, "query_node").select("query_node", "node", "v", "qv")
        scored = met.mapInArrow(work, "query_node long, node long, d double").withColumn("expanded", F.lit(False))
        both = found.withColumn("expanded", F.lit(True)).unionByName(scored)
        found = scratch.keep(both.withColumn("rank", rank).where(F.col("rank") <= beam).drop("rank"), f"beam{turn}")
        scratch.drop(f"beam{turn - 1}")
        scratch.drop(f"met{turn}")
        if found.where("not expanded").isEmpty():
            return found


def nearest(embeddings: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """The k nearest of each query row, by the graph: query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(usable(embeddings), "rows")
    nodes, members = distinct_nodes(rows, scratch, k + 1)
    state = build(nodes, scratch)
    asked = rows.select("vec_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b")).where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "a", "b").distinct()
    prints = nodes.select(F.col("node").alias("query_node"), F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b"))
    asked = scratch.keep(asked.join(prints, ["a", "b"]).select("query_id", "query_node"), "asked")
    found = scratch.keep(search(asked, state, nodes, scratch), "found")
    scratch.drop_all_but("asked", "found", "members")
    # Of a beam's nodes, and of a node's members, only so many can be among the nearest.
    order = F.row_number().over(Window.partitionBy("query_node").orderBy("d", "vec_id"))
    best = found.join(members, "node").withColumn("order", order).where(F.col("order") <= 2 * k + 2)
    answered = asked.join(best, "query_node").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.sqrt(F.min("d")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answered.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
