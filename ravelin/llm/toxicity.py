"""Toxicity: a factorization machine over hashed terms.

``score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over the distinct
hashed terms of a text. The pairwise part lets two terms that are harmless
alone (a slur-like word, a group's name) count together, which additive
weights can't. Every hashed term of the sample has its weights and factors; no
term is left out for telling little alone.

Fitting uses a bounded, documented sample of the labelled rows
(``per_class`` of each label, chosen by a hash of the id). Terms are hashed in
the workers, one task fits the machine on the sample, and the driver gets the
weights of ``2 ** HASH_BITS`` terms at most, whatever the tables' size. Scoring
reads every whole text, map-only. Terms are maximal runs of letters and digits
in lower case, and their beginnings of a few lengths.

Null and empty texts have no terms and get ``sigmoid(w0)``; null labels, and
labels other than 0 and 1, don't take part in fitting; without labels of both
kinds the score is the known rate (0.0 without any). Of labels that repeat for
an id the larger counts. Repeated rows, and rows without a doc_id, are scored
each; very long texts are a block of their own; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.lake import fits_broadcast
from ravelin.llm.textblocks import NOT_ALNUM, blocks, constants, distinct, freeing, hashes, plain, row_sums, sorted_unique, splitmix, spread, utf8, words

HASH_BITS = 20
THRESHOLD = 0.3
#: Bytes of the word beginnings that are terms too, so that inflected forms share weights.
STEMS = (4, 5, 6)
#: Rows that a term needs to count half.
RARITY = 50
#: The squared score of association at which a term alone counts half.
EVIDENCE = 9.0
_STEM_KEYS = constants(42, len(STEMS))


@dataclass(frozen=True)
class FactorizationMachine:
    bias: float
    linear: np.ndarray  # for each hashed term; 0 where the sample has none
    factors: np.ndarray

    def raw(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Raw score of rows given by ragged ranges of terms."""
        v = self.factors[terms].astype(np.float64)
        sums, squares = row_sums(v, first), row_sums((v * v).sum(axis=1), first)
        return self.bias + row_sums(self.linear[terms], first) + 0.5 * ((sums**2).sum(axis=1) - squares)

    def scores(self, column: pa.Array) -> np.ndarray:
        ids, first = term_ids(column)
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, first), -40, 40)))


def term_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row: flat ids, and the first of each row (n + 1)."""
    buf, off = utf8(pc.utf8_lower(plain(column)))
    starts, ends, first = words(buf, off, NOT_ALNUM)
    codes, strings = distinct(buf, starts, ends)
    if not strings:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    # Of each distinct word: the terms of it and of its beginnings, which fit in eight bytes.
    sizes = np.array([len(x) for x in strings], np.int64)
    padded = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    at = np.cumsum(sizes) - sizes
    eight = np.zeros((len(strings), 8), np.uint8)
    for k in range(max(STEMS)):
        eight[:, k] = padded[at + k]
    eight = eight.view("<u8").ravel()
    terms = [hashes(strings, 41)]
    for n, key in zip(STEMS, _STEM_KEYS, strict=True):
        terms.append(np.where(sizes >= n, splitmix((eight & np.uint64((1 << 8 * n) - 1)) ^ key), terms[0]))  # a short word's own term again
    table = (np.stack(terms, axis=1) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    # Distinct words of each row first: most words repeat.
    rows = np.repeat(np.arange(len(off) - 1), np.diff(first))
    own = sorted_unique(rows * len(strings) + codes)
    rows, codes = own // len(strings), own % len(strings)
    pairs = sorted_unique(((rows << HASH_BITS)[:, None] | table[codes]).ravel())
    return pairs & ((1 << HASH_BITS) - 1), np.searchsorted(pairs >> HASH_BITS, np.arange(len(off)))


def sample_of(known: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``per_class`` ids of each label by a hash of the id, and the ids of each label."""
    counts = {int(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda k: min(1.0, per_class / max(1, counts.get(k, 0)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    return known.where(draw < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0))), counts


def training_terms(sample: DataFrame) -> DataFrame:
    @freeing
    def work(batches):
        for batch in batches:
            for part in blocks(batch):
                ids, first = term_ids(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), lists], ["doc_id", "toxic", "ids"])

    return sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(work, "doc_id long, toxic int, ids array<int>")


def trained(ids: np.ndarray, first: np.ndarray, y: np.ndarray, factors: int, epochs: int, rate: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Bias, terms, weights and factors, by AdaGrad on the logistic loss.

    In pairs a term's value is ``df / (df + RARITY)`` for its ``df`` rows: rare terms
    count less, so that they can't tell single texts apart, and none is left out. Alone,
    its value is ``(z**2 / (z**2 + EVIDENCE)) ** 2`` for the score ``z`` of its own association
    with the label: terms that say nothing alone are left to their pairs.
    """
    own, terms, df = np.unique(ids, return_inverse=True, return_counts=True)
    p = y.mean()
    value = df / (df + RARITY)
    toxic = np.bincount(terms, weights=np.repeat(y, np.diff(first)), minlength=len(own))
    z = (toxic - df * p) / np.sqrt(df * p * (1 - p) + 1.0)
    alone = (z**2 / (z**2 + EVIDENCE)) ** 2
    rng = np.random.default_rng(7)
    w0, w, v = float(np.log(p / (1 - p))), np.zeros(len(own)), rng.normal(0, 0.01, (len(own), factors))
    gw, gv, g0 = np.full(len(own), 1e-3), np.full((len(own), factors), 1e-3), 1e-3
    for _ in range(epochs):
        turn = rng.permutation(len(y))
        for at in range(0, len(turn), 256):
            docs = turn[at : at + 256]
            n = first[docs + 1] - first[docs]
            there, flat = np.unique(terms[spread(first[docs], n)], return_inverse=True)
            edge = np.concatenate(([0], np.cumsum(n)))
            x, x1 = value[there], alone[there]
            vf = (v[there] * x[:, None])[flat]
            s = row_sums(vf, edge)
            raw = w0 + row_sums((w[there] * x1)[flat], edge) + 0.5 * ((s**2).sum(axis=1) - row_sums((vf * vf).sum(axis=1), edge))
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[docs]) / len(docs)
            each = np.repeat(g, n)
            d0 = g.sum()
            g0 += d0**2
            w0 -= rate * d0 / np.sqrt(g0)
            dw = np.bincount(flat, weights=each, minlength=len(there)) * x1 + 1e-5 * w[there]
            gw[there] += dw**2
            w[there] -= rate * dw / np.sqrt(gw[there])
            pull = np.repeat(s * g[:, None], n, axis=0) - each[:, None] * vf
            dv = np.stack([np.bincount(flat, weights=pull[:, f], minlength=len(there)) for f in range(factors)], axis=1) * x[:, None] + 1e-4 * v[there]
            gv[there] += dv**2
            v[there] -= 0.2 * rate * dv / np.sqrt(gv[there])
    return w0, own, w * alone, v * value[:, None]


def calibrated(raw: np.ndarray, y: np.ndarray, rate_1: float) -> tuple[float, float]:
    """Slope and shift that make raw scores of rows outside training log-odds, for labels at ``rate_1``."""
    weight = np.where(y == 1, rate_1 / y.mean(), (1 - rate_1) / (1 - y.mean()))
    x = np.stack((raw, np.ones_like(raw)), axis=1)
    beta = np.array([1.0, np.log(rate_1 / (1 - rate_1)) - np.log(y.mean() / (1 - y.mean()))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (weight * (p - y)) + 0.5 * (beta - [1.0, beta[1]]))
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 0.1), float(beta[1])


def model_of(ids: np.ndarray, first: np.ndarray, y: np.ndarray, rate_1: float, factors: int, epochs: int, rate: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Train on three quarters of the rows and calibrate on the rest (on all, if a part lacks a label)."""
    fourth = np.arange(len(y)) % 4 == 3
    if not (0 < y[fourth].mean() < 1 and 0 < y[~fourth].mean() < 1 if fourth.any() else False):
        fourth[:] = False

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = first[rows + 1] - first[rows]
        return ids[spread(first[rows], n)], np.concatenate(([0], np.cumsum(n)))

    own_ids, own_first = part(np.flatnonzero(~fourth))
    w0, own, w, v = trained(own_ids, own_first, y[~fourth], factors, epochs, rate)
    rest = np.flatnonzero(fourth if fourth.any() else ~fourth)
    rest_ids, rest_first = part(rest)
    place = np.minimum(np.searchsorted(own, rest_ids), max(len(own) - 1, 0))
    place = np.where(own[place] == rest_ids, place, len(own)) if len(own) else np.zeros(0, np.int64)
    raw = FactorizationMachine(w0, np.append(w, 0.0), np.concatenate((v, np.zeros((1, v.shape[1]))))).raw(place, rest_first)
    slope, shift = calibrated(raw, y[rest], rate_1)
    return slope * w0 + shift, own, slope * w, np.sqrt(slope) * v


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 4000, factors: int = 4, epochs: int = 5, rate: float = 0.12) -> FactorizationMachine:
    """Learn from the labelled rows of ``documents``."""
    size = 1 << HASH_BITS
    linear, latent = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn, counts = sample_of(known, per_class)
    total = sum(counts.values())
    rate_1 = counts.get(1, 0) / total if total else 0.0
    if not 0 < rate_1 < 1:
        return FactorizationMachine(40.0 if rate_1 else -40.0, linear, latent)
    if fits_broadcast(3 * per_class, 32):
        drawn = F.broadcast(drawn)  # about 2 * per_class ids, whatever the tables' size
    sample = documents.select("doc_id", "text").join(drawn, "doc_id")

    @freeing
    def work(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held).combine_chunks()
        got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy(), kind="stable")))
        y, lists = got["toxic"].to_numpy().astype(np.float64), got["ids"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        if not 0 < y.mean() < 1:
            return
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        # The sample's classes are drawn at their own rates; calibration goes back to the table's.
        w0, own, w, v = model_of(lists.flatten().to_numpy(), first, y, rate_1, factors, epochs, rate)
        edge = pa.array(np.arange(0, len(own) * factors + 1, factors), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([w0]), pa.array([[0.0] * factors], pa.list_(pa.float32()))], ["term", "w", "v"])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(w), pa.ListArray.from_arrays(edge, pa.array(v.astype(np.float32).ravel()))], ["term", "w", "v"])

    # One task sees the sample, which is bounded by per_class.
    rows = training_terms(sample).repartition(1).mapInArrow(work, "term int, w double, v array<float>").toArrow().combine_chunks()
    if not rows.num_rows:
        return FactorizationMachine(float(np.log(rate_1 / (1 - rate_1))), linear, latent)
    term, w = rows["term"].to_numpy(), rows["w"].to_numpy()
    v = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, factors)
    known_terms = term >= 0
    linear[term[known_terms]], latent[term[known_terms]] = w[known_terms], v[known_terms]
    return FactorizationMachine(float(w[~known_terms][0]), linear, latent)


def score(documents: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** HASH_BITS terms, factors + 1 floats each

    @freeing
    def work(batches):
        fm = shared.value
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fm.scores(part.column("text")))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def flag(documents: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    return score(documents, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def below(documents: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score under the threshold, in one map-only pass."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @freeing
    def work(batches):
        fm = shared.value
        for batch in batches:
            for part in blocks(batch):
                yield part.filter(pa.array(fm.scores(part.column("text")) < threshold))

    return documents.mapInArrow(work, documents.schema)
