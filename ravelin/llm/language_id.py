"""Language ID: segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public byte-pair
vocabulary. A word's likelihood is the sum, over *all* its segmentations into
pieces, of the products of piece probabilities; a forward algorithm computes it
in one pass over the word. A text's log-likelihood is the sum over its words
(pieces don't cross words). Piece probabilities come from expectation
maximisation (forward-backward over all segmentations), started from the
vocabulary, on words of a bounded sample of rows with a known language.

Words are runs of letters in lower case; bytes of multi-byte characters count
as letters. All 256 bytes are pieces, so that every word has a segmentation.
Scores are posteriors under equal priors. Null texts and texts without a letter
get ``und`` and 0.0; without any learnable row so does every text. Ties go to
the language that sorts first. Repeated rows, and rows without a doc_id, are
judged each; an empty table gives an empty result; extra columns are ignored.
Very long words cost time in proportion to their length.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.textblocks import blocks, constants, distinct, freeing, plain, row_sums, splitmix, utf8, words

#: Words of ASCII other than letters end a word here.
NOT_LETTER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
CACHE_WORDS = 400_000
#: Longer training words are learned from in parts of so many bytes, cut between characters.
PART = 256
_SIZES = constants(62, 1 << 12)


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file (base64 and rank in each line) that are lower-case letters, and all single bytes."""
    out = {bytes([i]) for i in range(256)}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            piece = base64.b64decode(line.split()[0]).strip()
            if len(piece) > 1 and not any(NOT_LETTER[c] or 65 <= c <= 90 for c in piece):
                out.add(piece)
    return sorted(out)


@dataclass
class PieceModel:
    languages: list[str]
    keys: np.ndarray  # sorted hashes of pieces
    lengths: list[int]  # of pieces, in bytes
    probabilities: np.ndarray  # pieces and a last row of zeros, by languages


class Strings:
    """Byte strings, and hashes of their ranges: each eight bytes are mixed in turn, and the length."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        buf = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        self.eights = np.lib.stride_tricks.as_strided(buf, (len(buf) - 7, 8), (1, 1)).copy().view("<u8").ravel()

    def hashed(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Of the n bytes from each start."""
        out = np.full(len(starts), _SIZES[n % len(_SIZES)] + np.uint64(n))
        for at in [0] if n < 8 else [*range(0, n - 8, 8), n - 8]:
            part = self.eights[starts + at]
            out = splitmix(out ^ (part & np.uint64((1 << 8 * n) - 1) if n < 8 else part))
        return out


def _piece_hashes(pieces: list[bytes]) -> np.ndarray:
    each, out = Strings(pieces), np.zeros(len(pieces), np.uint64)
    for n in np.unique(each.sizes):
        rows = np.flatnonzero(each.sizes == n)
        out[rows] = each.hashed(each.starts[rows], int(n))
    return out


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each hash, or len(keys)."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys))


def _steps(text: Strings, starts: np.ndarray, end: int, model: PieceModel) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For words that begin at ``starts``: pieces that end after ``end`` bytes, as (length, words that have one, its row)."""
    for n in model.lengths:
        if n <= end:
            at = _lookup(model.keys, text.hashed(starts + end - n, n))
            has = np.flatnonzero(at < len(model.keys))
            if len(has):
                yield n, has, at[has]


def forward(text: Strings, model: PieceModel) -> np.ndarray:
    """Log-likelihoods (words by languages): the sum over all segmentations of each word."""
    out = np.zeros((len(text.sizes), len(model.languages)))
    longest = model.lengths[-1]
    for size in np.unique(text.sizes):
        rows = np.flatnonzero(text.sizes == size)
        window = [np.ones((len(rows), len(model.languages)))]  # of the last positions, divided by exp(scale)
        scale = np.zeros_like(window[0])
        for end in range(1, int(size) + 1):
            total = np.zeros_like(scale)
            for n, has, at in _steps(text, text.starts[rows], end, model):
                total[has] += window[-n][has] * model.probabilities[at]
            window = [*window[-longest + 1 :], total]
            if end % 16 == 0:
                top = np.maximum(total, 1e-300)
                scale += np.log(top)
                window = [w / top for w in window]
        out[rows] = np.log(np.maximum(window[-1], 1e-300)) + scale
    return out


def _expectation(texts: list[bytes], counts: np.ndarray, model: PieceModel) -> np.ndarray:
    """Expected piece counts over all segmentations (forward-backward), by languages."""
    text = Strings(texts)
    expected = np.zeros_like(model.probabilities)
    for size in np.unique(text.sizes):
        rows = np.flatnonzero(text.sizes == size)
        steps = [list(_steps(text, text.starts[rows], end, model)) for end in range(1, int(size) + 1)]
        # Both passes are divided by the forward pass's scale, position by position.
        alpha, divided = [np.ones((len(rows), len(model.languages)))], []
        for end, pieces in enumerate(steps, 1):
            total = np.zeros_like(alpha[0])
            for n, has, at in pieces:
                past = alpha[end - n][has]
                for k in range(end - n, end - 1):
                    past = past / divided[k][has]
                total[has] += past * model.probabilities[at]
            divided.append(np.maximum(total, 1e-300))
            alpha.append(total / divided[-1])
        beta = [np.zeros_like(alpha[0]) for _ in range(size)] + [np.ones_like(alpha[0])]
        found, gains = [], []
        for end in range(int(size), 0, -1):
            for n, has, at in steps[end - 1]:
                ahead = model.probabilities[at] * beta[end][has]
                for k in range(end - n, end):
                    ahead = ahead / divided[k][has]
                beta[end - n][has] += ahead
                found.append(at)
                gains.append(alpha[end - n][has] * ahead * counts[rows][has])
        at, gain = np.concatenate(found), np.concatenate(gains)
        for k in range(gain.shape[1]):
            expected[:, k] += np.bincount(at, weights=gain[:, k], minlength=len(expected))
    return expected


def _parts(word: bytes) -> list[bytes]:
    """A word in parts of ``PART`` bytes at most, cut between characters."""
    out = []
    while len(word) > PART:
        cut = PART
        while cut > PART - 4 and word[cut] & 0xC0 == 0x80:
            cut -= 1
        out.append(word[:cut])
        word = word[cut:]
    return [*out, word]


def _normalised(expected: np.ndarray) -> np.ndarray:
    smooth = expected + 0.05
    smooth[-1] = 0
    return smooth / smooth.sum(axis=0)


def fit(documents: DataFrame, vocabulary_path: str, per_language: int = 100, rounds: int = 3) -> PieceModel:
    """Learn from rows of ``documents`` (doc_id, text, lang) with text and lang.

    The sample's bound: about ``per_language`` rows of each language, by a hash
    of the id, and all their words. The number of languages must be one that a
    model can hold; it is the number of distinct values of ``lang``.
    """
    known = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    hashes = _piece_hashes(pieces := vocabulary(vocabulary_path))
    keys = hashes[order := np.argsort(hashes)]
    lengths = sorted({len(p) for p in pieces})
    if not languages:
        return PieceModel([], keys, lengths, np.zeros((len(keys) + 1, 0)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 24)) / float(1 << 24)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    sample = known.where(draw < share[F.col("lang")])
    tokens = sample.select("lang", F.explode(F.split(F.lower("text"), r"[\x00-\x60\x7b-\x7f]+")).alias("word")).where("word <> ''")
    tallied = tokens.groupBy("lang", "word").agg(F.count("*").alias("n"))
    found: dict[bytes, dict[str, int]] = defaultdict(dict)
    for lang, word, n in tallied.toLocalIterator():  # the words of a bounded sample
        for part in _parts(word.encode()):
            found[part][lang] = found[part].get(lang, 0) + n
    texts = sorted(found)
    weights = np.array([[found[w].get(lang, 0) for lang in languages] for w in texts], float).reshape(len(texts), len(languages))
    size = np.array([len(p) for p in pieces], float)[order]
    start = np.concatenate((np.exp(-size), [0]))  # EM starts from lengths alone
    model = PieceModel(languages, keys, lengths, _normalised(np.repeat(start[:, None], len(languages), axis=1) * len(keys)))
    for _ in range(rounds if texts else 0):
        model.probabilities = _normalised(_expectation(texts, weights, model))
    return model


def predict(documents: DataFrame, model: PieceModel) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    @freeing
    def work(batches):
        m: PieceModel = shared.value
        names = np.array([*m.languages, "und"], object)
        width = len(m.languages)
        known, values = {}, np.zeros((0, width))
        for batch in batches:
            for part in blocks(batch):
                text = plain(part.column("text"))
                letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                buf, off = utf8(pc.utf8_lower(text))
                starts, ends, first = words(buf, off, NOT_LETTER)
                back, strings = distinct(buf, starts, ends)
                if len(known) + len(strings) > CACHE_WORDS:
                    known, values = {}, values[:0]
                new = [x for x in strings if x not in known]
                if new and width:
                    values = np.concatenate((values[: len(known)], forward(Strings(new), m)))
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                rows = np.array([known[x] for x in strings], np.int64)[back]
                total = row_sums(values[rows], first) if width else np.zeros((part.num_rows, 0))
                if width:
                    top = total.argmax(axis=1)
                    share = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
                else:
                    top, share = np.zeros(len(total), int), np.zeros(len(total))
                    letters = np.zeros(len(total), bool)
                top, share = np.where(letters, top, width), np.where(letters, share, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[top], pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
