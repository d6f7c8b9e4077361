"""Near-dedup and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import near_dedup, substring_dedup
from tests.llm.conftest import text_of


def near_copies():
    rows = [(0, None), (1, ""), (2, "   \n"), (3, "one two"), (4, "ONE two"), (5, "one two three four five"), (6, "x" * 3000)]
    for g in range(3):
        base = text_of(g, 60 + 20 * g).split()
        for k in range(25):
            w = list(base)
            for m in range(k % 9):
                w[(7 * m + k) % len(w)] = f"e{g}{k}{m}"
            rows.append((100 + 100 * g + k, " ".join(w)))
        rows += [(1000 + 100 * g + k, " ".join(base)) for k in range(10)]
    return rows


def brute_components(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def classes_of(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.similar_classes(frame).collect()}


def test_components(docs):
    rows = near_copies()
    assert classes_of(docs(rows, extra=True)) == brute_components(rows)


@pytest.mark.parametrize("rare", [2, 64])
def test_group_around_the_threshold(docs, monkeypatch, rare):
    """Copies with many edits: links, pairs just under the threshold, and sets that link with nothing."""
    monkeypatch.setattr(near_dedup, "RARE", rare)
    r = random.Random(11)
    base, rows = text_of(77, 120).split(), []
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(1, 12)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], [w[at], text_of(k, 1)], [f"n{r.randrange(6)}"]])
        rows.append((k, " ".join(w)))
    assert classes_of(docs(rows)) == brute_components(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_few_words_in_all(docs, n):
    rows = [(7, " ".join("abcde"[:n]))]
    assert classes_of(docs(rows)) == brute_components(rows)


def test_long_structured_words(docs):
    """Words of two letters that polynomial hashes modulo a power of two take for equal."""
    a = "a"
    for _ in range(11):
        a = a + a.translate(str.maketrans("ab", "ba"))
    rows = [(k, x) for k, x in enumerate([a, a.translate(str.maketrans("ab", "ba")), a[:1024], a[1024:], "a" * 2048, "b" * 2048])]
    assert classes_of(docs(rows)) == brute_components(rows)


def test_repeated_and_missing_ids(docs):
    text, other = text_of(1, 50), text_of(2, 50)
    got = near_dedup.similar_classes(docs([(5, text), (5, text), (6, text), (7, other), (7, "own words of this text are six"), (None, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, False), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True)]


def test_estimate_keeps_links_at_the_threshold():
    """Of pairs with a similarity of exactly 0.75, none is under the estimate's bound and nearly all share a band."""
    rng = np.random.default_rng(3)
    under = apart = 0
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 160).astype(np.uint64)
        sketch, bands = near_dedup.signature_columns(np.array([near_dedup.minima(x[:140]), near_dedup.minima(x[20:])]))
        differ = np.bitwise_xor(sketch[0], sketch[1]).view(np.uint64)
        unlike = int(np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
        under += ((1 - unlike / near_dedup.MINIMA) - 0.25) / 0.75 < near_dedup.LEAST_ESTIMATE
        apart += not (bands[0] == bands[1]).any()
    assert under == 0 and apart <= 1


def test_empty_tables(docs):
    assert near_dedup.similar_classes(docs([])).count() == 0
    assert substring_dedup.deduplicated(docs([])).count() == 0


def test_estimate(spark):
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = (np.unique(np.concatenate((shared, rng.integers(0, 2**63, 50, dtype=np.uint64)))) for _ in range(2))
    sketch, _ = near_dedup.signature_columns(np.array([near_dedup.minima(a), near_dedup.minima(b)]))
    df = spark.createDataFrame([(sketch[0].tolist(), sketch[1].tolist())], "a array<long>, b array<long>")
    assert abs(df.select(near_dedup.estimate(F.col("a"), F.col("b"))).first()[0] - 0.8) < 0.15


def repeats():
    passage = text_of(50, 30)
    rows = [(0, None), (1, ""), (2, "ab" * 200), (3, passage), (4, f"{text_of(1, 20)} {passage} {text_of(2, 9)}"), (5, passage), (6, f"é{passage[3:]}ü"), (7, text_of(3, 40)), (8, "a" * 99), (9, "a" * 99)]
    return [*rows, *[(20 + k, f"{text_of(60 + k, 8)} {passage[:140]} {text_of(70 + k, 8)}") for k in range(12)], *[(50 + k, text_of(90, 25)) for k in range(6)]]


def brute_removed(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            else:
                seen[w] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize(("large", "chunk"), [(8192, 4 << 20), (3, 4 << 20), (8192, 150)])
def test_removed_bytes(docs, monkeypatch, large, chunk):
    monkeypatch.setattr(substring_dedup, "LARGE_ANCHOR", large)
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    rows = repeats()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.deduplicated(docs(rows, extra=True)).collect()}
    assert got == brute_removed(rows)


def test_cut_texts(docs):
    rows = repeats()
    kept = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs(rows)).collect()}
    removed = brute_removed(rows)
    assert 5 not in kept and set(kept) == {i for i, (n, k, _, _) in removed.items() if k < n or n == 0}
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept.values())
    assert all(len((kept[i]["text"] or "").encode()) >= n - k for i, (n, k, _, _) in removed.items() if i in kept)


def test_ids_that_repeat(docs):
    """Rows of one id with other texts are told apart; equal rows don't cover each other, later ones are covered."""
    line = text_of(5, 30)
    rows = [(1, "start\n" + line), (2, line), (2, "short"), (2, "own " + text_of(6, 30)), (2, line), (3, "x " + line + " y"), (None, line)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in substring_dedup.deduplicated(docs(rows)).collect())
    n = len(line)
    assert got == sorted([(0, n, 0), (1, n + 6, 0), (2, 5, 0), (2, n, n), (2, n, n), (2, len(text_of(6, 30)) + 4, 0), (3, n + 4, n)])
    twice = substring_dedup.deduplicated(docs([(2, line), (2, line)])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]


def test_structured_bytes(docs):
    """Long strings of two letters, on which polynomial hashes modulo a power of two fail."""
    a = "a"
    for _ in range(11):
        a = a + a.translate(str.maketrans("ab", "ba"))
    rows = [(0, a), (1, a[::-1]), (2, a[:300] + "c" + a[700:]), (3, "ab" * 700)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.deduplicated(docs(rows)).collect()}
    assert got == brute_removed(rows)
