"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers, units and names are
replaced with typed placeholders, all else is lower-cased and stripped of outer
punctuation. Windows of ``WINDOW`` template tokens of benchmark items are
hash-joined with those of documents. A title-case word is a name by three
readings of a text: within sentences only, at the opening of sentences and lines
too, and nowhere (case-folded, so that copies in other case match); windows are
keyed by each reading that differs. A name has a capital letter first and
letters only (``Ann``, ``McDonald``, ``O'Brien``, ``ANN``). Windows with fewer than ``SHORTEST`` literal
tokens are keyed on their exact values: only equal text matches them. Matching
windows of one alignment must fill their slots consistently: an item's value
that returns must return as the same value in the document, and different
values must stay different (the first reading can veto an alignment). So "Ann has 3 kg ... Ann" finds "Bob has 7 lb ...
Bob" but not a text in which the second name is another.

A document leaks an item where consistent windows cover at least
``MIN_COVERAGE`` of the item's windows, of all or of those with enough literal
tokens. A re-parameterised copy in which names aren't title-case is not known
by its names. The result has one row per (doc_id,
item_id): windows, matched, coverage, reparameterised.

Only windows that some item has leave the workers. The item side is broadcast
behind a check of its size and otherwise exchanged. Items shorter than a window
are one window of their own length. Several texts under one item_id are
variants: the best covered one counts. Null or empty texts match nothing, nor do
rows without an id; repeated rows count once; very long texts are a block of
their own; an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.lake import Scratch, fits_broadcast
from ravelin.llm.textblocks import SPACES, blocks, constants, distinct, freeing, plain, splitmix, utf8, words

WINDOW = 8
SHORTEST = 4
MIN_COVERAGE = 0.5
CACHE_WORDS = 200_000
# Unit words that a re-parameterised question may change.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent $ dollar dollars cent cents € euro euros £ °c °f degree degrees mph kph km/h m/s hz khz mhz ghz kb mb gb tb w kw mw j kj cal kcal v".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:e[+-]?\d+)?(?:%|st|nd|rd|th|[a-z]{1,3})?")
NUM, UNIT, NAME = 1, 2, 3
_MIX = constants(32, WINDOW + 1)
_HOLES = constants(33, 4)
_EXACT = constants(34, 1)[0]
#: Bits of the readings: names within sentences, at openings too, nowhere.
WITHIN, OPENINGS, NOWHERE = 1, 2, 4
#: Readings of an item and of a document whose windows may meet.
MEETINGS = ((WITHIN, WITHIN), (OPENINGS, OPENINGS), (NOWHERE, NOWHERE), (WITHIN, OPENINGS), (OPENINGS, WITHIN))
_known: dict[bytes, tuple[int, int, bool, bool]] = {}


def classify(word: str) -> tuple[int, int, bool, bool]:
    """Hash of the bare word in lower case, its kind (0: literal), whether it is cased like a name, whether it ends a sentence."""
    bare = word.strip("\"'“”‘’«»()[]{}<>.,;:!?¡¿…*_`#|&")
    ends = word.rstrip("\"'”’»)]*_`#|&").endswith((".", "!", "?", ":"))
    low = bare.lower()
    kind = 0
    if not bare:
        kind = -1
    elif NUMBER.fullmatch(low):
        kind = NUM
    elif low in UNITS:
        kind = UNIT
    named = len(bare) > 1 and bare[0].isupper() and bare.replace("'", "").replace("’", "").replace("-", "").isalpha()
    return xxhash.xxh3_64_intdigest(low), kind, named, ends


class Templates:
    """Template tokens of a block's rows: hash, slot kind, value and row."""

    def __init__(self, column: pa.Array):
        buf, off = utf8(plain(column))
        starts, ends, first = words(buf, off, SPACES)
        back, strings = distinct(buf, starts, ends)
        if len(_known) + len(strings) > CACHE_WORDS:
            _known.clear()
        for x in strings:
            if x not in _known:
                _known[x] = classify(x.decode("utf-8", "replace"))
        info = [_known[x] for x in strings]
        value = np.array([x[0] for x in info], np.uint64)[back]
        kind, named, stops = (np.array([x[j] for x in info], t)[back] for j, t in ((1, np.int8), (2, bool), (3, bool)))
        lines = np.concatenate(([0], np.cumsum(buf == 10)))
        opening = np.ones(len(starts), bool)
        if len(starts) > 1:
            opening[1:] = stops[:-1] | (lines[starts[1:]] > lines[ends[:-1]])
        opening[first[:-1][first[:-1] < len(starts)]] = True
        keep = kind >= 0
        within = np.where((kind == 0) & named & ~opening, NAME, kind)[keep]
        openings = np.where((kind == 0) & named, NAME, kind)[keep]
        self.value = value[keep]
        self.kinds = {WITHIN: within, OPENINGS: openings, NOWHERE: kind[keep]}
        self.first = np.concatenate(([0], np.cumsum(keep)))[first]
        self.mixed = splitmix(self.value)

    def windows(self, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each reading: key, first token, row, bits of the readings with this key, kinds' reading, whether it is a template."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        rows = np.repeat(np.arange(len(counts)), counts)
        before = np.cumsum(counts) - counts
        at = np.repeat(self.first[:-1] - before, counts) + np.arange(int(counts.sum()))
        n = max(0, len(self.value) - size + 1)

        def hashed(token: np.ndarray) -> np.ndarray:
            out = np.full(n, np.uint64(size) * _MIX[WINDOW], np.uint64)
            for k in range(size):
                out += token[k : k + n] * _MIX[k]
            return splitmix(out)[at]

        exact = hashed(self.mixed ^ _EXACT)
        keys, enough = {}, {}
        for reading, kind in self.kinds.items():
            literal = np.concatenate(([0], np.cumsum(kind == 0)))
            enough[reading] = literal[at + size] - literal[at] >= SHORTEST
            keys[reading] = np.where(enough[reading], hashed(np.where(kind > 0, _HOLES[kind], self.mixed)), exact)
        out, seen = [], []
        template = enough[WITHIN]
        for reading, key in keys.items():
            new = np.ones(len(at), bool)
            for other in seen:
                new &= key != keys[other]
            seen.append(reading)
            bits = sum((np.where(key == keys[other], other, 0) for other in keys), np.zeros(len(at), np.int8))
            out.append((key[new], at[new], rows[new], bits[new].astype(np.int8), np.where(enough[reading][new], reading, 0), template[new]))
        return out


ROWS = "doc_id long, place int, key long, bits byte, template boolean, kinds array<byte>, slot_values array<long>"


def _window_rows(part: pa.RecordBatch, name: str, sizes: list[int] | None, wanted: np.ndarray | None) -> pa.RecordBatch:
    """Windows of a block, of the given sizes (None: an item's own), that are wanted (None: all)."""
    t = Templates(part.column("text"))
    lengths = np.diff(t.first)
    out = []
    for size in sorted(set(np.minimum(lengths, WINDOW).tolist())) if sizes is None else sizes:
        if size < 1:
            continue
        for keys, at, rows, bits, reading, template in t.windows(size):
            fit = np.minimum(lengths, WINDOW)[rows] == size if sizes is None else np.ones(len(rows), bool)
            if wanted is not None and len(wanted):
                spot = np.searchsorted(wanted, keys)
                spot[spot == len(wanted)] = 0
                fit &= wanted[spot] == keys
            out.append((keys[fit], at[fit], rows[fit], np.full(int(fit.sum()), size), bits[fit], reading[fit], template[fit]))
    types = (np.uint64, np.int64, np.int64, np.int64, np.int8, np.int64, bool)
    keys, at, rows, sizes_, bits, reading, template = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, t_) for k, t_ in enumerate(types))
    flat = np.repeat(at - (np.cumsum(sizes_) - sizes_), sizes_) + np.arange(int(sizes_.sum()))
    edge = pa.array(np.concatenate(([0], np.cumsum(sizes_))), pa.int32())
    names = part.column(name).to_numpy(zero_copy_only=False)
    # Exact windows have no slots.
    by = np.repeat(reading, sizes_)
    kinds = np.zeros(len(flat), np.int8)
    for one, kind in t.kinds.items():
        kinds = np.where(by == one, kind[flat], kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(names[rows], pa.int64()), pa.array((at - t.first[rows]).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(bits), pa.array(template), pa.ListArray.from_arrays(edge, pa.array(kinds.astype(np.int8))), pa.ListArray.from_arrays(edge, pa.array(t.value[flat].view(np.int64)))],
        ["doc_id", "place", "key", "bits", "template", "kinds", "slot_values"],
    )


def item_windows(benchmark: DataFrame) -> DataFrame:
    @freeing
    def work(batches):
        for batch in batches:
            for part in blocks(batch):
                yield _window_rows(part, "item_id", None, None)

    rows = benchmark.select(F.col("item").alias("item_id"), "text").mapInArrow(work, ROWS)
    return rows.select(F.col("doc_id").alias("item"), F.col("place").alias("item_place"), "key", F.col("bits").alias("item_bits"), F.col("template").alias("item_template"), F.col("slot_values").alias("item_values"))


def document_windows(documents: DataFrame, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    @freeing
    def work(batches):
        for batch in batches:
            for part in blocks(batch):
                yield _window_rows(part, "doc_id", sizes, shared.value)
        _known.clear()

    return documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ROWS)


def leaks(documents: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per (doc_id, item_id) that leaks."""
    scratch = Scratch(documents.sparkSession)
    # Texts that share an item's id are variants of it, each matched by itself.
    variants = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    variants = scratch.keep(variants, "variants")
    items = scratch.keep(item_windows(variants), "items")
    sizes = sorted(r[0] for r in items.select(F.size("item_values")).distinct().collect())  # WINDOW values at most
    n = items.count()
    small = fits_broadcast(n, 8 * (WINDOW + 6), broadcast_bytes)
    wanted = np.sort(np.array([r[0] for r in items.select("key").distinct().collect()], np.int64).view(np.uint64)) if small else None
    found = document_windows(documents, sizes if n else [], wanted)
    places = items.select("item", "item_place", "item_template").distinct()
    totals = places.groupBy("item").agg(F.count("*").alias("windows"), F.sum(F.col("item_template").cast("long")).alias("templates"))
    met = found.join(F.broadcast(items) if small else items, "key")
    pairs = F.filter(F.arrays_zip("kinds", "item_values", "slot_values"), lambda s: s["kinds"] > 0)
    meetings = F.array(*[F.when((F.col("item_bits").bitwiseAND(i) > 0) & (F.col("bits").bitwiseAND(d) > 0), F.lit(8 * i + d)) for i, d in MEETINGS])
    met = met.select("doc_id", "item", "item_place", "item_template", (F.col("place") - F.col("item_place")).alias("shift"), F.filter(meetings, lambda m: m.isNotNull()).alias("meetings"), F.transform(pairs, lambda s: F.struct(s["item_values"].alias("a"), s["slot_values"].alias("b"))).alias("slots"))
    met = met.withColumn("meeting", F.explode("meetings"))
    met = met.groupBy("doc_id", "item", "shift", "meeting", "item_place").agg(F.first("slots").alias("slots"), F.first("item_template").alias("item_template"))
    # An alignment has one window for each place of the item at most, so its arrays are bounded by the item.
    aligned = met.groupBy("doc_id", "item", "shift", "meeting").agg(F.collect_set(F.struct("item_place", "item_template")).alias("places"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    one_way = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: s[side]))) == F.size("slots")
    changed = F.exists("slots", lambda s: s["a"] != s["b"])
    told = aligned.select("doc_id", "item", "shift", "meeting", "places", (one_way("a") & one_way("b")).alias("consistent"), changed.alias("changed"))
    within = (F.col("meeting") == 9 * WITHIN) & ~F.col("consistent")
    told = told.withColumn("vetoed", F.max(within).over(Window.partitionBy("doc_id", "item", "shift")))
    spots = told.where("consistent and not vetoed").select("doc_id", "item", F.explode("places").alias("place"), "changed")
    covered = spots.groupBy("doc_id", "item", "place").agg(F.min("changed").alias("changed"))
    covered = covered.groupBy("doc_id", "item").agg(F.count("*").alias("matched"), F.sum(F.col("place.item_template").cast("long")).alias("matched_templates"), F.max("changed").alias("reparameterised"))
    # Of all windows or of the templates: exact windows of a re-parameterised item cannot match.
    coverage = F.greatest(F.col("matched") / F.col("windows"), F.when(F.col("templates") > 0, F.col("matched_templates") / F.col("templates")))
    named = variants.select("item", "item_id")
    told = covered.join(F.broadcast(totals) if small else totals, "item").where(coverage >= min_coverage).join(F.broadcast(named) if small else named, "item")
    best = F.max(F.struct(F.round(coverage, 6).alias("coverage"), "matched", "windows", (~F.col("reparameterised")).alias("verbatim"))).alias("best")
    return told.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.windows", "best.matched", "best.coverage", (~F.col("best.verbatim")).alias("reparameterised"))


def clean(documents: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents that leak no item."""
    return documents.join(leaks(documents, benchmark, min_coverage).select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)
