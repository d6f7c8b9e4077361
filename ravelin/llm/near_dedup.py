"""MinHash near-dedup with b-bit signatures.

A document's set holds its distinct five-word shingles (64-bit hashes); with
fewer words, the whole sequence is the one shingle. Two documents link where
``100 * |A & B| >= 75 * |A | B|``; classes are the connected components.

1. One map-only pass gives each document its set's size and 128-bit identity,
   band keys (32 bands of 4 minima: a pair at the threshold shares no band with
   probability 5e-6), and the low 2 bits of each of 512 minima, packed.
2. Documents with equal sets are one *class*; only its smallest id goes on.
3. Band buckets never emit their pairs. First a bucket's smallest member is its
   centre, then a member of its largest component, which settles nearly all.
   What then shares a bucket but no component is settled at once by an exact
   bound (``unlinked_pairs``): shingles that at most ``RARE`` of these sets have
   are joined, so that shared ones are counted, and popular ones are bounded by
   the smaller number of them. Nothing is capped: a pair that the bound does not
   rule out is compared.
4. A candidate first meets the b-bit estimate ``(match - 1/4) / (1 - 1/4)``,
   where ``match`` counts equal 2-bit fields; below 0.6 (6.5 standard
   deviations under the threshold) it can't be a link. The rest is confirmed on
   the full sets, each centre's text being sent once for each block of members.
5. Components come from minimum labels with pointer jumping, in joins.

A group of near copies whose members lie just under the threshold leaves many
pairs that no bound rules out; these are compared, at a cost that can grow
faster than the group.

Null texts and texts without words have an empty set and link with nothing.
Equal rows are alike. Rows that share a doc_id but not a text are classed each
by its own text. Rows without a doc_id have no component (null) and are not
kept. Very long texts are one block of their own. Empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.lake import Scratch, fits_broadcast
from ravelin.llm.textblocks import SPACES, ascii_lower, blocks, constants, freeing, plain, sorted_unique, splitmix, utf8, word_hashes, words

WIDTH = 5
THRESHOLD = 75
#: Minima for the estimate; the first ``BANDS * ROWS`` of them make the band keys.
MINIMA, BANDS, ROWS = 512, 32, 4
BITS = 2
LEAST_ESTIMATE = 0.6
PER_BLOCK = 200
#: A shingle of more sets than that is popular: pairs are not made through it.
RARE = 64
_MIX = constants(92, WIDTH + 1)
_A = (constants(93, MINIMA) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (constants(94, MINIMA, odd=False) >> np.uint64(32)).astype(np.uint32)
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>, bands array<long>"


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    buf, off = utf8(plain(column))
    buf = ascii_lower(buf)
    starts, ends, first = words(buf, off, SPACES)
    keys = word_hashes(buf, starts, ends, 91)
    whole = np.zeros(max(0, len(keys) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        whole += keys[k : k + len(whole)] * _MIX[k]
    whole = splitmix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(sorted_unique(whole[a : b - WIDTH + 1]))
        elif b > a:
            parts = np.append(keys[a:b], np.uint64(b - a)) * np.append(_MIX[: b - a], _MIX[WIDTH])
            out.append(splitmix(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(whole[:0])
    return out


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    first = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    second = np.array([splitmix(s ^ _MIX[0]).sum(dtype=np.uint64) for s in sets], np.uint64)
    return first.view(np.int64), second.view(np.int64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the permutations over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(best, (x[at : at + 512, None] * _A + _B).min(axis=0), out=best)
    return best


def signature_columns(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (documents by words) and band keys of minima (documents by permutations)."""
    mixed = splitmix(best.astype(np.uint64))
    bits = (mixed & np.uint64((1 << BITS) - 1)).reshape(len(best), MINIMA * BITS // 64, 64 // BITS)
    sketch = (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
    grouped = mixed[:, : BANDS * ROWS].reshape(len(best), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = splitmix(key ^ grouped[:, :, k])
    return sketch.view(np.int64), key.view(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    @freeing
    def work(batches):
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column("text"))
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                named = set_names(sets)
                sketch, bands = signature_columns(np.array([minima(sets[i]) for i in full], np.uint32).reshape(len(full), MINIMA))
                edge = np.concatenate(([0], np.cumsum(sizes > 0)))
                lists = [pa.ListArray.from_arrays(pa.array(edge * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (sketch, bands)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), *map(pa.array, named), *lists], ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "bands"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SIGNATURE)


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity from two packed signatures."""
    unlike = F.lit(0)
    for k in range(MINIMA * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        unlike = unlike + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 1 / (1 << BITS)
    return ((1 - unlike / MINIMA) - chance) / (1 - chance)


def sets_of(documents: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows of ``wanted`` (doc_id, set_a, and more) with the texts that have these sets."""
    if fits_broadcast(n, 64):
        wanted = F.broadcast(wanted)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")


def confirmed(candidates: DataFrame, documents: DataFrame, named: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Of candidate pairs (centre, member), those that link on their full sets. ``named``: (rep, set_a)."""
    candidates = scratch.keep(candidates, f"{name}-candidates")
    n = candidates.count()
    share = candidates.groupBy("centre").agg(F.ceil(F.count("*") / PER_BLOCK).alias("blocks"))
    dealt = candidates.join(share, "centre").select("centre", "member", F.pmod(F.xxhash64("member"), F.col("blocks")).alias("block"))
    wanted = dealt.select("centre", "block", F.lit(1).alias("part"), F.col("member").alias("rep")).unionByName(dealt.select("centre", "block").distinct().select("centre", "block", F.lit(0).alias("part"), F.col("centre").alias("rep")))
    wanted = wanted.join(named, "rep").withColumnRenamed("rep", "doc_id")
    rows = sets_of(documents, wanted, n).select("centre", "block", "part", "doc_id", "set_a", "text")

    @freeing
    def work(batches):
        key, own = None, None
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column("text"))
                found = []
                for c, b, kind, name, wanted, s in zip(*(part.column(k).to_pylist() for k in ("centre", "block", "part", "doc_id", "set_a")), sets, strict=True):
                    if s.sum(dtype=np.uint64).astype(np.int64) != wanted:
                        continue  # another text under the same id
                    if not kind:
                        key, own = (c, b), s
                    elif key == (c, b):
                        both = np.sort(np.concatenate((own, s)))
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= THRESHOLD * (len(own) + len(s) - common):
                            found.append((c, name))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["centre", "member"])

    dealt_out = rows.repartition("centre", "block").sortWithinPartitions("centre", "block", "part", "doc_id")
    return scratch.keep(dealt_out.mapInArrow(work, "centre long, member long").distinct(), f"{name}-links")


def contracted(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, of edges (a, b): minimum labels with pointer jumping."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    state = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(state, both["b"] == state["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = state.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        ahead = state.select(F.col("node").alias("next"), F.col("root").alias("ahead"))
        jumped = scratch.keep(nearer.join(ahead, "next").select("node", "root", F.least("next", "ahead").alias("next")), f"{name}-{turn}")
        state = jumped.select("node", F.col("next").alias("root"))
        if jumped.where("next <> root").isEmpty():
            return state


def shingles_of(crowd: DataFrame, documents: DataFrame) -> DataFrame:
    """(rep, root, shingle) of the sets of ``crowd`` (rep, root, set_a)."""

    @freeing
    def work(batches):
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column("text"))
                own = part.column("set_a").to_numpy()
                sets = [s if s.sum(dtype=np.uint64).astype(np.int64) == w else s[:0] for s, w in zip(sets, own, strict=True)]
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(part.column(c).to_numpy(), sizes), pa.int64()) for c in ("doc_id", "root")), pa.array(flat.view(np.int64))], ["rep", "root", "shingle"])

    return sets_of(documents, crowd.withColumnRenamed("rep", "doc_id"), crowd.count()).select("doc_id", "root", "set_a", "text").mapInArrow(work, "rep long, root long, shingle long")


def unlinked_pairs(left: DataFrame, profiles: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs (centre, member) of different components within ``left`` (key, rep, root): all that can be links.

    A shingle is popular if more than ``RARE`` sets of ``left`` have it. Two sets
    share ``min(popular_a, popular_b)`` popular ones at most, and exactly as many
    others as a join on those counts. Sets that share none of the others meet in
    their buckets, by sizes that the popular ones allow.
    """
    crowd = scratch.keep(left.select("rep", "root").distinct().join(profiles.select("rep", "n", "set_a"), "rep"), "crowd")
    rows = scratch.keep(shingles_of(crowd.select("rep", "root", "set_a"), documents), "shingles")
    popular = scratch.keep(rows.groupBy("shingle").agg(F.count("*").alias("sets")).where(F.col("sets") > RARE).select("shingle"), "popular")
    if fits_broadcast(popular.count(), 32):
        popular = F.broadcast(popular)
    others = rows.join(popular, "shingle", "left_anti")
    counted = others.groupBy("rep").agg(F.count("*").alias("others"))
    sized = scratch.keep(crowd.join(counted, "rep", "left").select("rep", "root", "n", (F.col("n") - F.coalesce("others", F.lit(0))).alias("popular")), "sized")

    def enough(shared: Column) -> Column:
        return 100 * shared >= THRESHOLD * (F.col("n_a") + F.col("n_b") - shared)

    def side(tag: str) -> DataFrame:
        return sized.select(F.col("rep").alias(tag), F.col("n").alias(f"n_{tag}"), F.col("popular").alias(f"popular_{tag}"))

    # At most RARE sets have one of these shingles, so the lists are short whatever the group.
    lists = others.groupBy("shingle").agg(F.collect_list(F.struct("rep", "root")).alias("all")).where(F.size("all") > 1)
    pairs = lists.select("all", F.explode("all").alias("one")).select(F.col("one.rep").alias("a"), F.explode(F.filter("all", lambda x: (x["rep"] > F.col("one.rep")) & (x["root"] != F.col("one.root")))).alias("two"))
    shared = pairs.groupBy("a", F.col("two.rep").alias("b")).agg(F.count("*").alias("shared"))
    through_shingles = shared.join(side("a"), "a").join(side("b"), "b").where(enough(F.least("popular_a", "popular_b") + F.col("shared"))).select("a", "b")

    # Without shared others: min(popular) >= 3/7 of both sizes together bounds the other's size from both sides.
    most = F.floor(F.col("popular") * 7 / 3 - F.col("n"))
    able = left.select("key", "rep").join(sized.where(100 * F.col("popular") >= THRESHOLD * F.col("n")), "rep")
    main = able.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    step = lambda n: F.floor(F.ln(n) / 0.1)
    minor = able.join(main, "key").where("root <> main").select("key", F.col("rep").alias("x"), F.col("root").alias("root_x"), F.col("n").alias("n_a"), F.col("popular").alias("popular_a"), F.explode(F.sequence(step(F.ceil(F.col("n") * 0.75)), step(F.greatest(most, F.ceil(F.col("n") * 0.75))))).alias("step"))
    other = able.select("key", F.col("rep").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_b"), F.col("popular").alias("popular_b"), step(F.col("n")).alias("step"))
    in_buckets = minor.join(other, ["key", "step"]).where((F.col("root_x") != F.col("root_y")) & enough(F.least("popular_a", "popular_b"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return through_shingles.unionByName(in_buckets).distinct().select(F.col("a").alias("centre"), F.col("b").alias("member"))


def similar_classes(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    signed = scratch.keep(signatures(documents), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    classes = scratch.keep(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    reps = signed.withColumnRenamed("doc_id", "rep").join(classes, [*same, "rep"], "left_semi").dropDuplicates([*same, "rep"])
    keys = reps.select("rep", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
    members = scratch.keep(keys.join(crowded.select("key", "least"), "key"), "members")
    profiles = signed.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "set_a", "set_b", "sketch").join(members.select("rep").distinct(), "rep", "left_semi")
    profiles = scratch.keep(profiles.dropDuplicates(["rep", "n", "set_a", "set_b"]), "profiles")

    def likely(pairs: DataFrame) -> DataFrame:
        """Of (centre, member), those whose sizes and estimate allow a link."""
        met = pairs
        for tag in ("centre", "member"):
            met = met.join(profiles.select(F.col("rep").alias(tag), F.col("n").alias(f"n_{tag}"), F.col("sketch").alias(f"sketch_{tag}")), tag)
        sizes = 100 * F.least("n_centre", "n_member") >= THRESHOLD * F.greatest("n_centre", "n_member")
        return met.where(sizes & (estimate(F.col("sketch_centre"), F.col("sketch_member")) >= LEAST_ESTIMATE)).select("centre", "member").distinct()

    def linked(roots: DataFrame | None, pairs: DataFrame, name: str) -> DataFrame | None:
        """The root of each node that has a link, after those among ``pairs``."""
        links = confirmed(likely(pairs), documents, profiles.select("rep", "set_a"), scratch, name)
        if links.isEmpty():
            return roots
        if roots is None:
            return scratch.keep(contracted(links.toDF("a", "b"), scratch, f"{name}-roots"), f"{name}-labels")
        # Earlier roots are the nodes now, so that each contraction meets new links only.
        edges = links
        for tag in ("centre", "member"):
            edges = edges.join(roots.toDF(tag, f"root_{tag}"), tag, "left").withColumn(tag, F.coalesce(f"root_{tag}", tag)).drop(f"root_{tag}")
        edges = scratch.keep(edges.where("centre <> member").toDF("a", "b"), f"{name}-contracted")
        if edges.isEmpty():
            return roots
        above = scratch.keep(contracted(edges, scratch, f"{name}-roots").toDF("root", "top"), f"{name}-tops")
        moved = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        new = above.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
        return scratch.keep(moved.unionByName(new), f"{name}-labels")

    def mixed(buckets: DataFrame, roots: DataFrame | None, name: str) -> DataFrame:
        """The members (key, rep, root) of buckets that hold several components."""
        inside = buckets.select("key", "rep").withColumn("root", F.col("rep"))
        if roots is not None:
            inside = buckets.select("key", "rep").join(roots.toDF("rep", "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
        several = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        return scratch.keep(inside.join(several, "key", "left_semi"), name)

    # First, each member with the smallest member of its buckets: that settles most.
    pairs = members.where("rep > least").groupBy(F.col("rep").alias("member")).agg(F.min("least").alias("centre")).select("centre", "member")
    roots = linked(None, pairs, "round0")
    left = mixed(members, roots, "left0")
    turn, before = 1, None
    while not left.isEmpty():
        # Then with another centre, one of the bucket's largest component, as long as that settles much.
        apart = left.select("rep", "root").distinct().agg(F.countDistinct("root")).first()[0]
        if before is not None and apart > 0.8 * before:
            roots = linked(roots, unlinked_pairs(left, profiles, documents, scratch), "rest")  # all that is left, at once
            break
        largest = left.groupBy("key", "root").agg(F.count("*").alias("size"), F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("centre"))
        centres = largest.groupBy("key").agg(F.max_by(F.struct("centre", "root"), F.struct("size", "root")).alias("c")).select("key", "c.centre", F.col("c.root").alias("centre_root"))
        pairs = left.join(centres, "key").where("root <> centre_root").groupBy(F.col("rep").alias("member")).agg(F.min("centre").alias("centre")).select("centre", "member")
        roots = linked(roots, pairs, f"round{turn}")
        before, turn, left = apart, turn + 1, mixed(left, roots, f"left{turn}")
    scratch.drop_all_but("signatures", "classes", *(x for x in scratch.names if x.endswith("-labels")))
    own = classes.withColumn("class_id", F.col("rep")) if roots is None else classes.join(roots.toDF("rep", "root"), "rep", "left").withColumn("class_id", F.coalesce("root", "rep"))
    found = signed.select("doc_id", *same).join(own.select(*same, "class_id"), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
