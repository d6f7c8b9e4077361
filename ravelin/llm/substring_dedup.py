"""Suffix-array dedup: every byte under a 100-byte string that also starts earlier goes.

"Earlier" means a smaller doc_id, or the same document and an earlier start.

1. Windows find their own shards. In each 100-byte window the smallest hashed
   16-byte gram (leftmost of equals) is its anchor; equal windows have equal
   anchors at equal offsets, wherever they stand. Consecutive windows with the
   same anchor form a *segment*; a map-only pass emits (anchor, fingerprint,
   document, place). Equal segments of a block of rows are combined before they
   leave the worker, so a line in a third of all documents is sent once for
   each block. A gram that anchors one segment only repeats nothing and ends here.
2. Segments that are equal byte for byte (80 bits of fingerprint within one
   anchor) are collapsed: all but the first are covered from end to end.
   That is what keeps groups of thousands of copies small.
3. Of anchors with several distinct segments the bytes are fetched and dealt to
   shards by anchor. A shard's suffix array is built by induced sorting, its
   common prefixes in text order; runs with 100 bytes in common are the classes
   of equal windows, and all but the earliest of a class are marked.
4. Marked windows are gathered by document and united with its text.

An anchor with more than ``LARGE_ANCHOR`` distinct segments (a line in a third of
all documents, with other text around it each time) would not fit a shard; its
windows are dealt by 128-bit fingerprints of their bytes, equal ones of a block
combined, which gives the same result and has no bound on the group.

Null texts are empty. Rows without a doc_id keep all bytes. Rows that share a
doc_id are told apart by their texts (23 bits of a hash) and don't cover each
other (no start is earlier). Very long texts are cut into chunks of windows.
Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.lake import Scratch, fits_broadcast
from ravelin.llm.suffix_arrays import common_prefixes, suffix_array
from ravelin.llm.textblocks import blocks, freeing, gram_hashes, plain, splitmix, spread, utf8

SPAN = 100
GRAM = 16
SHARD_BYTES = 3 << 19
LARGE_ANCHOR = 8192
_POSITION_BITS = 32
CHUNK = 4 << 20
#: A place packs a tag of the text, a start and a number of windows (an anchor has 85 at most).
_WINDOW_BITS, _START_BITS, _TAG_BITS = 7, 33, 23
#: An anchor packs 48 bits of the gram's hash and 16 bits of the segment's fingerprint.
_ANCHOR_SHIFT = 16
OCCURRENCE = "anchor long, seg long, doc_id long, place long"
RANGES = "doc_id long, place long"


def packed_place(tag: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (tag.astype(np.int64) << (_START_BITS + _WINDOW_BITS)) | (start.astype(np.int64) << _WINDOW_BITS) | windows.astype(np.int64)


def tag_of(place: np.ndarray) -> np.ndarray:
    return place >> (_START_BITS + _WINDOW_BITS)


def start_of(place: np.ndarray) -> np.ndarray:
    return (place >> _WINDOW_BITS) & ((1 << _START_BITS) - 1)


def windows_of(place: np.ndarray) -> np.ndarray:
    return place & ((1 << _WINDOW_BITS) - 1)


def text_tag(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data, 84) & ((1 << _TAG_BITS) - 1)


def covered(group: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of rows sorted by (group, doc, place): whether an equal one starts earlier."""
    n = len(group)
    if not n:
        return np.zeros(0, bool)
    tag = tag_of(place)
    head, own = np.ones(n, bool), np.ones(n, bool)
    head[1:] = group[1:] != group[:-1]
    own[1:] = head[1:] | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    # The first of its text stays if no smaller doc_id is in the group; a repeated row is no earlier start.
    earliest = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return ~((doc == doc[first]) & (start_of(place) == start_of(place[earliest])))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (van Herk: prefix and suffix minima of blocks)."""
    n = len(keys) - width + 1
    size = -(-len(keys) // width) * width
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    shaped = padded.reshape(-1, width)
    up = np.minimum.accumulate(shaped, axis=1).ravel()
    down = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of all rows: row, absolute start, windows, anchor, and two parts of a fingerprint of the bytes."""
    n = len(buf)
    lengths = np.diff(off)
    counts = np.maximum(lengths - SPAN + 1, 0)
    starts = spread(off[:-1], counts)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    grams = gram_hashes(buf, GRAM, 81)
    at = np.arange(n - GRAM + 1)
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    least = _sliding_least((grams & ~mask) | at.astype(np.uint64), SPAN - GRAM + 1)
    where = (least & mask).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), counts)
    own = where[starts]
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (rows[1:] != rows[:-1]))))
    size = np.diff(np.append(cut, len(starts)))
    begin = starts[cut]
    prints = fingerprints(buf, begin, begin + size + SPAN - 1)
    return rows[cut], begin, size, grams[own[cut]], prints[:, 0], prints[:, 1]


def fingerprints(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of a hash of each byte range, as two integers."""
    data, digest = memoryview(np.ascontiguousarray(buf)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def combined(first: np.ndarray, second: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of one block sorted by key, document and place, and which of them an equal one in the block covers."""
    turn = np.lexsort((place, doc, second, first))
    first, second, doc, place = first[turn], second[turn], doc[turn], place[turn]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return first, second, doc, place, covered(np.cumsum(new), doc, place)


def marked(first: np.ndarray, second: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """``combined``, in which covered rows carry a negative place and a key that spreads them: they only pass through."""
    first, second, doc, place, gone = combined(first, second, doc, place)
    first = np.where(gone, splitmix(doc.astype(np.uint64) ^ place.astype(np.uint64)).view(np.int64), first)
    return first, np.where(gone, 0, second), doc, np.where(gone, ~place, place)


def occurrences(documents: DataFrame) -> DataFrame:
    @freeing
    def work(batches):
        for batch in batches:
            for part in blocks(batch, limit=1 << 20):
                buf, off = utf8(plain(part.column("text")))
                if part.num_rows == 1 and len(buf) > CHUNK:  # one very long text, by chunks of windows
                    each = [(c, *segments(buf[c : c + CHUNK + SPAN - 1], np.array([0, min(CHUNK + SPAN - 1, len(buf) - c)]))) for c in range(0, len(buf) - SPAN + 1, CHUNK)]
                    rows, begin, size, anchor, low, high = (np.concatenate([x[k] + x[0] if k == 2 else x[k] for x in each]) for k in range(1, 7))
                else:
                    rows, begin, size, anchor, low, high = segments(buf, off)
                names = part.column("doc_id").to_numpy()
                data = buf.tobytes()
                tags = np.array([text_tag(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)
                mask = np.uint64((1 << _ANCHOR_SHIFT) - 1)
                anchor = ((anchor & ~mask) | (high & mask)).view(np.int64) if len(rows) else anchor
                out = marked(anchor, low.view(np.int64), names[rows], packed_place(tags[rows], begin - off[rows], size))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor", "seg", "doc_id", "place"])

    return documents.where("doc_id IS NOT NULL AND octet_length(text) >= 100").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, OCCURRENCE)


def collapsed(found: DataFrame) -> DataFrame:
    """Of occurrences that repeat: ``kind`` 0 is covered by an equal segment, 1 is kept and its anchor has other segments; 2 names a large anchor."""

    @freeing
    def work(batches):
        # What is known of the anchor that may go on in the next batch.
        state = {"anchor": None, "seg": None, "doc": 0, "last": (None, None, 0), "segments": 0, "held": None}

        def rows(kind: int, anchor, doc, place):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64())], ["kind", "anchor", "doc_id", "place"])

        for batch in batches:
            anchor, seg, doc, place = (batch.column(i).to_numpy() for i in range(4))
            passing = place < 0
            if passing.any():
                yield rows(0, anchor[passing], doc[passing], ~place[passing])
                anchor, seg, doc, place = (x[~passing] for x in (anchor, seg, doc, place))
            n = len(anchor)
            if not n:
                continue
            group = anchor >> _ANCHOR_SHIFT
            new_anchor, new_seg = np.ones(n, bool), np.ones(n, bool)
            new_anchor[1:] = group[1:] != group[:-1]
            new_seg[1:] = (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])
            new_anchor[0] = state["anchor"] != group[0]
            new_seg[0] = new_anchor[0] or state["seg"] != (anchor[0], seg[0])
            tag, start = tag_of(place), start_of(place)
            own = new_seg.copy()
            own[1:] |= (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
            own[0] |= state["last"][:2] != (doc[0], tag[0])
            index = np.arange(n)
            head = np.maximum.accumulate(np.where(new_seg, index, -1))
            head_doc = np.where(head >= 0, doc[head], state["doc"])
            run = np.maximum.accumulate(np.where(own, index, -1))
            run_start = np.where(run >= 0, start[run], state["last"][-1])
            stays = (doc == head_doc) & (start == run_start)
            number = np.cumsum(new_anchor)  # 0: the anchor that goes on
            distinct_of = np.bincount(number, weights=new_seg, minlength=number[-1] + 1).astype(np.int64)
            distinct_of[0] += state["segments"]
            several = distinct_of[number] > 1
            yield rows(0, anchor[~stays], doc[~stays], place[~stays])
            needed = stays & several
            yield rows(1, anchor[needed], doc[needed], place[needed])
            if number[0] == 0 and distinct_of[0] > 1 and state["held"] is not None:
                yield rows(1, *state["held"])
                state["held"] = None
            ended = np.flatnonzero(distinct_of[:-1] > LARGE_ANCHOR)
            for k in ended.tolist():
                whose = state["anchor"] if k == 0 else group[np.flatnonzero(number == k)[0]]
                if whose is not None:
                    yield rows(2, [whose], [0], [0])
            # The anchor that ends the batch may go on: what stays of its only segment waits.
            last = number == number[-1]
            if distinct_of[-1] > 1:
                state["held"] = None
            else:
                mine = last & stays
                held = (anchor[mine], doc[mine], place[mine])
                if number[-1] == 0 and state["held"] is not None:
                    held = tuple(np.concatenate(x) for x in zip(state["held"], held, strict=True))
                state["held"] = held
            state |= {"anchor": int(group[-1]), "seg": (anchor[-1], seg[-1]), "doc": int(head_doc[-1]), "last": (doc[-1], tag[-1], int(run_start[-1])), "segments": int(distinct_of[-1])}
        if state["segments"] > LARGE_ANCHOR:
            yield rows(2, [state["anchor"]], [0], [0])

    dealt = found.repartition(F.shiftright("anchor", _ANCHOR_SHIFT)).sortWithinPartitions("anchor", "seg", "doc_id", "place")
    return dealt.mapInArrow(work, "kind byte, anchor long, doc_id long, place long")


def shard_ranges(doc: np.ndarray, place: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of windows of a shard's segments that have an earlier equal window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # 255 is in no UTF-8 text
    s = np.zeros(len(joined) + 1, np.int64)
    s[:-1] = joined
    s[:-1] += 1
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    order = suffix_array(s, 257)
    shared = common_prefixes(s, order, 2 * SPAN + GRAM, begin)
    left = np.zeros(len(s), np.int64)  # bytes up to the segment's end
    left[spread(begin, sizes)] = np.repeat(sizes, sizes) - (spread(begin, sizes) - np.repeat(begin, sizes))
    shared = np.minimum(shared, np.minimum(left[order], np.concatenate(([0], left[order[:-1]]))))
    run = np.cumsum(shared < SPAN)
    many = np.bincount(run)[run] > 1
    where, run = order[many], run[many]
    own = np.searchsorted(begin, where, side="right") - 1
    at = where - begin[own]
    real = at < windows_of(place)[own]
    own, at, run = own[real], at[real], run[real]
    where = packed_place(tag_of(place[own]), start_of(place[own]) + at, np.ones(len(own), np.int64))
    turn = np.lexsort((where, doc[own], run))
    own, where, run = own[turn], where[turn], run[turn]
    later = covered(run, doc[own], where)
    return joined_ranges(doc[own[later]], where[later])


def joined_ranges(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of documents as few rows (doc, place): consecutive ones together, as many as a place can hold."""
    turn = np.lexsort((place, doc))
    doc, place = doc[turn], place[turn]
    if not len(doc):
        return doc, place
    tag, start = tag_of(place), start_of(place)
    most = (1 << _WINDOW_BITS) - 1
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)
    # A run is cut again wherever it has ``most`` windows more than where it began.
    first = np.maximum.accumulate(np.where(cut, np.arange(len(doc)), 0))
    within = start - start[first]
    cut[1:] |= within[1:] // most != within[:-1] // most
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], packed_place(tag[at], start[at], start[last] - start[at] + 1)


def by_suffix_arrays(pieces: DataFrame) -> DataFrame:
    """Covered ranges among rows (key, other, doc_id, place, piece), shard by shard.

    Rows with a piece are segments under their anchor; those without are single
    windows under their fingerprint; those with a negative place are covered already.
    """

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        doc, place = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in shard_ranges(doc, place, [r[2] for r in rows])], ["doc_id", "place"])

    @freeing
    def work(batches):
        rows, size, last = [], 0, None
        before = None  # the last window: key, other, doc, tag, start; and the first of its group and of its run
        for batch in batches:
            key, other, doc, place = (batch.column(i).to_numpy() for i in range(4))
            single = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            gone = place < 0
            out = [(doc[gone], ~place[gone])]
            alone = np.flatnonzero(single & ~gone)
            if len(alone):
                k, o, d, p = (x[alone] for x in (key, other, doc, place))
                if before is not None:  # the group that goes on: its first row and the first of its last text stand in for it
                    k, o, d, p = (np.concatenate((b, x)) for b, x in zip(before, (k, o, d, p), strict=True))
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                number = np.cumsum(new)
                later = covered(number, d, p)
                skip = 0 if before is None else len(before[0])
                later[:skip] = False
                out.append(joined_ranges(d[later], p[later]))
                head = np.flatnonzero(new)[-1]
                own = head + np.flatnonzero((d[head:] == d[-1]) & (tag_of(p[head:]) == tag_of(p[-1])))[0]
                stand = sorted({int(head), int(own)})
                before = tuple(x[stand] for x in (k, o, d, p))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in (0, 1)], ["doc_id", "place"])
            held = np.flatnonzero(~single)
            for k, *row in zip(key[held].tolist(), doc[held].tolist(), place[held].tolist(), batch.column(4).take(pa.array(held)).to_pylist(), strict=True):
                if size >= SHARD_BYTES and k != last:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2]) + 1
                last = k
        if rows:
            yield shard(rows)

    return pieces.repartition("key", "other").sortWithinPartitions("key", "other", "doc_id", "place").mapInArrow(work, RANGES)


def cut_pieces(rows: DataFrame) -> DataFrame:
    """Bytes of the wanted segments of ``rows`` (doc_id, text, __want); of large anchors, a fingerprint of each of their windows."""

    @freeing
    def pieces(batches):
        for batch in batches:
            for part in blocks(batch, limit=1 << 19):
                out, singles = [[], [], [], []], [[], [], [], []]
                for name, text, want in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "__want")), strict=True):
                    if not want:
                        continue
                    data = text.encode()
                    tag, buf = text_tag(data), np.frombuffer(data, np.uint8)
                    place = np.array([w["place"] for w in want], np.int64)
                    mine = tag_of(place) == tag
                    starts, sizes = start_of(place), windows_of(place)
                    for k in np.flatnonzero(mine).tolist():
                        start, size = int(starts[k]), int(sizes[k])
                        if not want[k]["large"]:
                            for column, value in zip(out, (want[k]["anchor"] >> _ANCHOR_SHIFT, name, int(place[k]), data[start : start + size + SPAN - 1]), strict=True):
                                column.append(value)
                        else:
                            at = start + np.arange(size)
                            prints = fingerprints(buf, at, at + SPAN).view(np.int64)
                            for column, value in zip(singles, (prints[:, 0], prints[:, 1], np.full(size, name), packed_place(np.full(size, tag), at, np.ones(size))), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([0] * len(out[0]), pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["key", "other", "doc_id", "place", "piece"])
                if singles[0]:
                    heads = marked(*(np.concatenate(x).astype(np.int64) for x in singles))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in heads), pa.nulls(len(heads[0]), pa.binary())], ["key", "other", "doc_id", "place", "piece"])

    return rows.mapInArrow(pieces, "key long, other long, doc_id long, place long, piece binary")


def covered_ranges(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, place): starts of 100-byte strings that also start earlier."""
    split = scratch.keep(collapsed(occurrences(documents)), "segments")
    large = split.where("kind = 2").select(F.col("anchor").alias("group"), F.lit(True).alias("large"))
    n = large.count()
    needed = split.where("kind = 1").select("anchor", "doc_id", "place")
    if not n:
        needed = needed.withColumn("large", F.lit(False))
    else:
        needed = needed.withColumn("group", F.shiftright("anchor", _ANCHOR_SHIFT)).join(F.broadcast(large) if fits_broadcast(n, 16) else large, "group", "left").select("anchor", "doc_id", "place", F.coalesce("large", F.lit(False)).alias("large"))
    lists = needed.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "large")).alias("__want"))
    # The same left join as in ``with_ranges``: the exchange of the texts is made once and used twice.
    pieces = cut_pieces(documents.join(lists, "doc_id", "left"))
    return split.where("kind = 0").select("doc_id", "place").unionByName(by_suffix_arrays(pieces))


def removal(places: list[int] | None, data: bytes) -> list[tuple[int, int]]:
    """Maximal removed runs [from, to) of a text, by the places that bear its tag."""
    if not places:
        return []
    place = np.array(places, np.int64)
    place = np.sort(place[tag_of(place) == text_tag(data)])
    if not len(place):
        return []
    start = start_of(place)
    end = np.maximum.accumulate(start + windows_of(place) - 1 + SPAN)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    last = np.append(new[1:], len(start)) - 1
    return [(int(a), min(int(b), len(data))) for a, b in zip(start[new], end[last], strict=True)]


def with_ranges(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """``documents`` with the list of its covered windows (null: none)."""
    lists = covered_ranges(documents, scratch).groupBy("doc_id").agg(F.collect_list("place").alias("__covered"))
    return documents.join(lists, "doc_id", "left")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = with_ranges(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), Scratch(documents.sparkSession))

    @freeing
    def work(batches):
        for batch in batches:
            for part in blocks(batch):
                out = [[], [], [], [], []]
                for name, text, places in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "__covered")), strict=True):
                    data = (text or "").encode()
                    gone = removal(places, data)
                    digest, at = hashlib.sha256(), 0
                    for a, b in gone:
                        digest.update(data[at:a])
                        at = b
                    digest.update(data[at:])
                    for column, value in zip(out, (name, len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated spans cut out of the text, at character boundaries.

    A character that a span covers only in part stays. Documents of which
    nothing is left go; ``n_chars`` follows the text.
    """
    # Other columns get names of their own, which can't clash with those used here.
    names = {x: x if x in ("doc_id", "text") else f"column{k}" for k, x in enumerate(documents.columns)}
    rows = documents.select(*[F.col(f"`{x}`").alias(n) for x, n in names.items()]).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = with_ranges(rows, Scratch(documents.sparkSession))

    @freeing
    def work(batches):
        for batch in batches:
            texts, alive = [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("__covered").to_pylist(), strict=True):
                if not places:
                    texts.append(text)
                    alive.append(True)
                    continue
                data = text.encode()
                parts, at = [], 0
                for a, b in removal(places, data):
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    parts.append(data[at:a])
                    at = b
                rest = b"".join([*parts, data[at:]]).decode()
                texts.append(rest)
                alive.append(bool(rest))
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, pa.string())).filter(pa.array(alive))

    schema = rows.schema
    cut = rows.mapInArrow(work, schema)
    out = {x: F.col(n) for x, n in names.items()}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("__covered").isNotNull(), F.length("text")).otherwise(out["n_chars"])
    return cut.select(*[column.cast(documents.schema[x].dataType).alias(x) for x, column in out.items()])
