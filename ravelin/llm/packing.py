"""Best-fit packing by minimum bin slack.

Lengths are small integers, so the whole packing problem is a histogram of at
most ``capacity`` counts however many documents there are. For each bin the
longest piece left is the seed; a bitset subset-sum dynamic program over the
lengths still available finds the fullest combination that fits beside it. That
combination is used as often as the counts allow and then removed; each step
exhausts a length, so that there are few distinct combinations (*patterns*).

Pieces then get ranks within their length, and a rank names its pattern, copy
and place. Ranks come from (length, bucket) groups of bounded size, so a length
that a third of all pieces have is spread like any other.

Null texts count as empty and become one piece with the end id alone. Repeated
rows are packed each (equal ids included). Empty tables give no pieces. Extra
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.lake import Scratch
from ravelin.llm.textblocks import SPACES, ascii_lower, blocks, distinct, freeing, plain, spread, table_of, utf8, words

CAPACITY = 2048
END_ID = 0
#: Remembered units of one worker (some 50 MB); when full, memory starts anew.
CACHE_WORDS = 300_000
#: A token of the vocabulary that stands between units which are encoded together.
BETWEEN = "<|endoftext|>"
TOGETHER = 1000
PER_BUCKET = 4000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


LETTERS = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
#: Punctuation that always opens a new pre-token after a letter (no apostrophe, and nothing of a special token's spelling).
OPENERS = table_of(b".,;:!?\"()[]{}-/*&%$#_=+~")


class WordCoder:
    """Ids of words, remembered.

    The vocabulary's pre-tokenizer never joins text across white space, nor an
    ASCII letter with punctuation after it, and it lower-cases; so the ids of a
    text are those of its lower-cased units, one after the other.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def coded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of units and how many each has. Many are encoded as one text, with a special token between them."""
        if self.between is None or any("<|" in u for u in units):
            each = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            return np.concatenate(each) if each else np.zeros(0, np.int64), np.array([len(x) for x in each], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([BETWEEN.join(units)], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(ids == self.between)
        return np.delete(ids, cuts), np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1

    def learn(self, units: list[bytes]) -> None:
        for k in range(0, len(units), TOGETHER):
            some = units[k : k + TOGETHER]
            ids, counts = self.coded([u.decode("utf-8", "replace") for u in some])
            need, at = self.used + len(ids), len(self.rows)
            if need > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(max(need, len(self.flat)), np.uint32)))
            while at + len(some) > len(self.starts):
                self.starts, self.counts = np.concatenate((self.starts, self.starts)), np.concatenate((self.counts, self.counts))
            self.flat[self.used : need] = ids
            self.starts[at : at + len(some)] = self.used + np.cumsum(counts) - counts
            self.counts[at : at + len(some)] = counts
            self.rows.update(zip(some, range(at, at + len(some)), strict=True))
            self.used = need

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows, and the first of each row (n + 1)."""
        buf, off = utf8(plain(column))
        if b"<|" not in buf.tobytes():  # else a special token could come of its capitals
            buf = ascii_lower(buf)
        cut = np.zeros(len(buf), bool)
        cut[1:] = LETTERS[buf[:-1]] & OPENERS[buf[1:]]
        starts, ends, first = words(buf, off, SPACES, cut)
        back, units = distinct(buf, starts, ends)
        if len(self.rows) + len(units) > CACHE_WORDS:
            self.clear()
        known = self.rows
        self.learn([u for u in units if u not in known])
        rows = np.array([known[u] for u in units], np.int64)[back] if units else back
        counts = self.counts[rows]
        total = np.concatenate(([0], np.cumsum(counts)))
        return self.flat[spread(self.starts[rows], counts)], total[first]


def tokenised(documents: DataFrame, definition: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids; only longer documents are cut."""
    shared = documents.sparkSession.sparkContext.broadcast(definition)  # one vocabulary file

    @freeing
    def work(batches):
        words_of = WordCoder(shared.value)
        for batch in batches:
            for part in blocks(batch):
                ids, first = words_of.ids(part.column("text"))
                names = part.column("doc_id").to_pylist()
                out = [[], [], [], [], []]
                for row, name in enumerate(names):
                    own = np.append(ids[first[row] : first[row + 1]], END_ID).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        cut = own[start : start + capacity]
                        for column, value in zip(out, (name, piece, start, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, PIECES)


@dataclass(frozen=True)
class Pattern:
    times: int
    items: tuple[tuple[int, int], ...]  # (length, how often in each bin)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum of at most ``room``, by bitset subset sums."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, batch = min(available[length], room // length), 1
        while left:
            take = min(batch, left)
            after = reach | ((reach << (take * length)) & mask)
            if after != reach:
                layers.append((length, take, reach))
                reach = after
            left -= take
            batch *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bins by minimum bin slack, equal ones together."""
    left = {k: n for k, n in histogram.items() if n > 0}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        beside = fullest({k: n for k, n in left.items() if n}, capacity - seed)
        left[seed] += 1
        beside[seed] = beside.get(seed, 0) + 1
        times = min(left[k] // n for k, n in beside.items())
        for k, n in beside.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append(Pattern(times, tuple(sorted(beside.items(), reverse=True))))
    return out


def slots(found: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces per bin, offset), sorted; as many as patterns have lengths."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for p in found:
        offset = 0
        for length, n in p.items:
            rows.append((length, used.get(length, 0), bins, n, offset))
            used[length] = used.get(length, 0) + n * p.times
            offset += n * length
        bins += p.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; ``pieces`` should be a written table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    layout = pieces.sparkSession.sparkContext.broadcast(slots(patterns(histogram, capacity)))
    buckets = max(1, sum(histogram.values()) // PER_BUCKET)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    @freeing
    def work(batches):
        rows = layout.value
        order = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = rows[np.searchsorted(order, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, F.col("rank").cast("long").alias("rank")).mapInArrow(work, PIECES + ", sequence_id long, offset long")


def pack(documents: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and offset."""
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    scratch = Scratch(documents.sparkSession)
    return assign(scratch.keep(tokenised(documents, definition, capacity), "pieces"), capacity)
