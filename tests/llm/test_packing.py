from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ravelin.llm import packing
from tests.llm.conftest import text_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_and_sequences(docs):
    rows = [(0, None), (1, ""), (2, text_of(1, 3000)), (3, "Don't  stop…\u00a0É <|endoftext|>x \u0301a"), (4, "x" * 5000), *[(10 + k, text_of(k, k)) for k in range(120)], (500, "same"), (501, "same")]
    got = packing.pack(docs(rows, extra=True), PATH, 256).toPandas()
    tokenizer, want, total = Tokenizer.from_file(PATH), {}, 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), 256)):
            want[i, k] = (a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x.offset.tolist() == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-total // 256) + 1


def test_fullest_is_optimal():
    r = random.Random(4)
    for _ in range(60):
        available = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(1, 60)
        sums = {0}
        for length, n in available.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        best = packing.fullest(available, room)
        assert sum(k * n for k, n in best.items()) == max(s for s in sums if s <= room)
        assert all(n <= available[k] for k, n in best.items())


def test_patterns_use_all():
    histogram = {3: 1000, 5: 77, 7: 3, 10: 1}
    found = packing.patterns(histogram, 10)
    used: dict[int, int] = {}
    for p in found:
        assert sum(k * n for k, n in p.items) <= 10
        for k, n in p.items:
            used[k] = used.get(k, 0) + n * p.times
    assert used == histogram


def test_empty(docs):
    assert packing.pack(docs([]), PATH).count() == 0
