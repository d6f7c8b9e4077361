"""Quality: an interpolated modified Kneser-Ney n-gram model over bytes.

Trained on all trusted text. Each text is a sequence of bytes (digits as ``0``),
opened by ``ORDER - 1`` zero bytes; an n-gram of up to five bytes packs into one
integer, so counts are exact and joins are on integers.

1. Counts of five-byte sequences are summed in each task, then by a sharded
   aggregation. Lower orders count distinct left extensions (continuations).
2. Discounts D1, D2 and D3+ come from the counts of counts of each order.
   Joins of count tables with their contexts' totals give, order by order, the
   interpolated probability of each n-gram and the weight that each context
   leaves to the next lower order.
3. Every text's per-byte log-perplexity is computed on these tables: in the
   workers where the tables pass a size check, and otherwise by joining the
   texts' distinct n-grams with the tables, shard by shard; the results agree.
4. A language's threshold is a quantile of the log-perplexities of those of its
   trusted texts that were held out of the counts (one in ``HELD_OUT``, by a hash
   of the id; from a histogram in steps of ``STEP``); a language without any gets
   the quantile of all. Texts at most at the threshold are kept.

Null and empty texts have no perplexity (null) and are not kept; rows without a
doc_id are scored and trusted by none; very long texts are a block of their own. A null language
is a language of its own. Without trusted text nothing is known: perplexities
and thresholds are null and every text with content is kept. Repeated rows are
scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.lake import Scratch, fits_broadcast
from ravelin.llm.textblocks import blocks, freeing, plain, row_sums, utf8

ORDER = 5
QUANTILE = 0.995
STEP = 0.001
HELD_OUT = 10
_FOLD = np.array([48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The five-byte n-gram that ends at each byte, and the first of each row (n + 1)."""
    buf, off = utf8(plain(column))
    rows = np.diff(off)
    padded = np.zeros(len(buf) + (ORDER - 1) * len(rows), np.int64)
    shift = np.repeat((np.arange(len(rows)) + 1) * (ORDER - 1), rows)
    place = np.arange(len(buf)) + shift
    padded[place] = _FOLD[buf]
    keys = np.zeros(len(buf), np.int64)
    for k in range(ORDER):
        keys |= padded[place - k] << (8 * k)
    return keys, off


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, back = np.unique(keys, return_inverse=True)
    return own, np.bincount(back, weights=counts, minlength=len(own)).astype(np.int64)


def counted(trusted: DataFrame) -> DataFrame:
    """(key, n) of all five-byte sequences of trusted texts."""

    @freeing
    def work(batches):
        total_keys, total_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            for at in range(0, len(total_keys), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(total_keys[at : at + 65536]), pa.array(total_counts[at : at + 65536])], ["key", "n"])

        for batch in batches:
            for part in blocks(batch):
                keys, counts = np.unique(packed(part.column("text"))[0], return_counts=True)
                total_keys, total_counts = _summed(np.concatenate((total_keys, keys)), np.concatenate((total_counts, counts)))
                if len(total_keys) > 1_000_000:
                    yield from out()
                    total_keys, total_counts = total_keys[:0], total_counts[:0]
        yield from out()

    return trusted.select("text").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney, from counts of counts."""
    r = counts.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()[0]
    n = [float(r[f"n{k}"] or 0) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3)]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def _low(c: Column | str, n: int) -> Column:
    """The last n bytes of a packed n-gram."""
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def tables(trusted: DataFrame, scratch: Scratch) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order: (key, p), the interpolated probability, and (context, weight), what is left to the lower order."""
    counts = {ORDER: scratch.keep(counted(trusted), f"counts{ORDER}")}
    for n in range(ORDER - 1, 0, -1):
        lower = counts[n + 1].groupBy(_low("key", n).alias("key")).agg(F.count("*").alias("n"))
        counts[n] = scratch.keep(lower, f"counts{n}")
    out: dict[int, tuple[DataFrame, DataFrame]] = {}
    for n in range(1, ORDER + 1):
        d = discounts(counts[n])
        context = F.shiftright("key", 8)
        by_context = counts[n].groupBy(context.alias("context")).agg(
            F.sum("n").alias("total"), *[F.sum((F.col("n") == k).cast("long") if k < 3 else (F.col("n") >= 3).cast("long")).alias(f"k{k}") for k in (1, 2, 3)]
        )
        by_context = by_context.select("context", "total", ((d[0] * F.col("k1") + d[1] * F.col("k2") + d[2] * F.col("k3")) / F.col("total")).alias("weight"))
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = counts[n].withColumn("context", context).join(by_context, "context").withColumn("own", (F.col("n") - less) / F.col("total"))
        if n == 1:
            probable = own.select("key", (F.col("own") + F.col("weight") / 256).alias("p"))
        else:
            below = out[n - 1][0].select(F.col("key").alias("rest"), F.col("p").alias("below"))
            probable = own.withColumn("rest", _low("key", n - 1)).join(below, "rest").select("key", (F.col("own") + F.col("weight") * F.col("below")).alias("p"))
        out[n] = (scratch.keep(probable, f"p{n}"), scratch.keep(by_context.select("context", "weight"), f"w{n}"))
    return out


class Lookup:
    """Rows of integer keys: levels of hash tables; keys that share a slot go to the next level."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.int64(-1))
        self.levels = []
        rows = np.arange(len(keys))
        while len(rows):
            bits = max(4, int(np.ceil(np.log2(4 * len(rows)))))
            odd = (0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * len(self.levels)) & ((1 << 64) - 1) | 1
            slot = self._slot(keys[rows], odd, bits)
            taken = np.bincount(slot, minlength=1 << bits)
            table = np.where(taken > 1, -2, -1).astype(np.int32)
            alone = taken[slot] == 1
            table[slot[alone]] = rows[alone]
            self.levels.append((odd, bits, table))
            rows = rows[~alone]

    @staticmethod
    def _slot(keys: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits)).astype(np.int64)

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        left = None
        for odd, bits, table in self.levels:
            keys = wanted if left is None else wanted[left]
            got = table[self._slot(keys, odd, bits)]
            ok = self.keys[got] == keys
            if left is None:
                out = np.where(ok & (got >= 0), got, -1).astype(np.int64)
                left = np.flatnonzero(got == -2)
            else:
                out[left[ok & (got >= 0)]] = got[ok & (got >= 0)]
                left = left[got == -2]
            if not len(left):
                break
        return out


@dataclass
class KneserNey:
    """The tables as arrays: for each order keys and log-probabilities, contexts and log-weights."""

    probable: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: dict[int, tuple[np.ndarray, np.ndarray]]

    def prepared(self) -> KneserNey:
        if not hasattr(self, "find"):
            self.find = {n: Lookup(k) for n, (k, _) in self.probable.items()}
            self.find_weight = {n: Lookup(k) for n, (k, _) in self.weights.items()}
        return self

    def log_probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), -np.log(256.0))
        rows = self.find[order].rows(keys)
        out = self.probable[order][1][rows]
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            rest = keys[missing]
            at = self.find_weight[order].rows(rest >> 8)
            weight = np.where(at >= 0, self.weights[order][1][at], 0.0)
            out[missing] = weight + self.log_probability(rest & ((1 << (8 * (order - 1))) - 1), order - 1)
        return out


def gathered(found: dict[int, tuple[DataFrame, DataFrame]]) -> KneserNey:
    def arrays(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        got = df.select(key, F.ln(value).alias("v")).orderBy(key).toArrow()
        return got[key].to_numpy(), np.append(got["v"].to_numpy(), 0.0)  # the last one: of keys that are not there

    return KneserNey({n: arrays(p, "key", "p") for n, (p, _) in found.items()}, {n: arrays(w, "context", "weight") for n, (_, w) in found.items()})


def score_in_workers(documents: DataFrame, model: KneserNey) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @freeing
    def work(batches):
        m = shared.value.prepared()
        for batch in batches:
            for part in blocks(batch):
                keys, first = packed(part.column("text"))
                n = np.diff(first)
                mean = -row_sums(m.log_probability(keys), first) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(n), pa.array(np.where(n > 0, np.round(mean, 6), np.nan), from_pandas=True)], ["doc_id", "lang", "n_bytes", "log_perplexity"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(work, "doc_id long, lang string, n_bytes long, log_perplexity double")


def score_by_joins(documents: DataFrame, found: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The same scores for tables of any size: distinct n-grams meet the tables in exchanges."""

    @freeing
    def work(batches):
        for batch in batches:
            for part in blocks(batch):
                keys, first = packed(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                order = np.lexsort((keys, row))
                keys, row = keys[order], row[order]
                cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])))) if len(keys) else np.zeros(0, int)
                times = np.diff(np.append(cut, len(keys)))
                yield pa.RecordBatch.from_arrays([part.column("unit").take(pa.array(row[cut])), pa.array(keys[cut]), pa.array(times)], ["unit", "key", "times"])

    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").withColumn("unit", F.monotonically_increasing_id())
    grams = rows.select("unit", "text").mapInArrow(work, "unit long, key long, times long")
    scored = grams.select("key").distinct().withColumn("sum", F.lit(0.0)).withColumn("rest", F.col("key")).withColumn("done", F.lit(False))
    for n in range(ORDER, 0, -1):
        p, w = found[n]
        scored = scored.join(p.select(F.col("key").alias("rest"), "p"), "rest", "left").withColumn("context", F.shiftright("rest", 8)).join(w, "context", "left")
        step = F.when(F.col("done"), F.lit(0.0)).when(F.col("p").isNotNull(), F.ln("p")).otherwise(F.coalesce(F.ln("weight"), F.lit(0.0)))
        scored = scored.select("key", (F.col("sum") + step).alias("sum"), (F.col("done") | F.col("p").isNotNull()).alias("done"), _low("rest", n - 1).alias("rest") if n > 1 else F.lit(0).alias("rest"))
    value = F.col("sum") + F.when(F.col("done"), 0.0).otherwise(-float(np.log(256.0)))
    sums = grams.join(scored.select("key", value.alias("v")), "key").groupBy("unit").agg((-F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.withColumn("n_bytes", size).drop("text").join(sums, "unit", "left").select("doc_id", "lang", "n_bytes", F.round("m", 6).alias("log_perplexity"))


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold), and the row (any: true) of all languages, of trusted scores."""
    step = F.ceil(F.col("log_perplexity") / STEP)
    bins = scored.where("log_perplexity IS NOT NULL").groupBy("lang", step.alias("bin")).agg(F.count("*").alias("n"))

    def of(frame: DataFrame, *by: str) -> DataFrame:
        keys = [F.lit(1)] if not by else [F.col(c) for c in by]
        up = Window.partitionBy(*keys).orderBy("bin")
        whole = Window.partitionBy(*keys)
        reached = frame.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(whole)).where(F.col("upto") >= F.lit(quantile) * F.col("all"))
        return reached.groupBy(*by).agg(F.round(F.min("bin") * STEP, 6).alias("threshold"))

    return of(bins, "lang").withColumn("any", F.lit(False)).unionByName(of(bins.groupBy("bin").agg(F.sum("n").alias("n"))).withColumn("any", F.lit(True)), allowMissingColumns=True)


def judged(documents: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, in_workers_bytes: int = 96 << 20) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, log_perplexity, threshold, kept."""
    scratch = Scratch(documents.sparkSession)
    ids = trusted_ids.select("doc_id").distinct()
    if fits_broadcast(ids.count(), 16):  # else the texts are exchanged by id
        ids = F.broadcast(ids)
    # One trusted text in HELD_OUT is not counted, so that thresholds come from texts that the model has not seen.
    unseen = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    texts = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    if texts.where(unseen & (F.octet_length("text") > 0)).isEmpty() or texts.where(~unseen & (F.octet_length("text") > 0)).isEmpty():
        unseen = F.lit(True)  # too few of them: all are counted, and all give the thresholds
        found = tables(texts, scratch)
    else:
        found = tables(texts.where(~unseen), scratch)
    n = sum(p.count() + w.count() for p, w in found.values())
    if fits_broadcast(n, 16, in_workers_bytes):
        scored = score_in_workers(documents, gathered(found))
    else:
        scored = score_by_joins(documents, found)
    scored = scratch.keep(scored if n else scored.withColumn("log_perplexity", F.lit(None).cast("double")), "scored")
    limits = scratch.keep(thresholds(scored.join(ids, "doc_id", "left_semi").where(unseen), quantile), "thresholds")
    scratch.drop_all_but("scored", "thresholds")
    every = limits.where("any").select(F.col("threshold").alias("overall"))
    own = limits.where("not any").select(F.col("lang").alias("l"), F.col("threshold").alias("of_lang"))
    limited = scored.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    threshold = F.coalesce("of_lang", "overall")
    kept = F.when(F.col("n_bytes") == 0, False).otherwise(F.coalesce(F.col("log_perplexity") <= threshold, F.lit(True)))
    return limited.select("doc_id", "lang", "n_bytes", "log_perplexity", threshold.alias("threshold"), kept.alias("kept"))
