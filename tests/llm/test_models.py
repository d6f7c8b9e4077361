"""Language ID, toxicity and quality: held-out accuracy, exact likelihoods, edge rows."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import language_id, quality, toxicity
from ravelin.llm.lake import table
from ravelin.llm.queries import held_out, op1_language_id, op4_toxicity, tokenizer_path
from tests.conftest import SMALL

VOCABULARY = tokenizer_path("byte_bpe_multi_50k.tiktoken")


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    hashes = language_id._piece_hashes(pieces)
    order = np.argsort(hashes)
    p = np.array([[0.3, 0.1], [0.2, 0.3], [0.2, 0.2], [0.2, 0.1], [0.1, 0.3]])
    model = language_id.PieceModel(["x", "y"], hashes[order], [1, 2, 3], np.vstack((p[order], np.zeros((1, 2)))))
    for n in (1, 3, 6, 40):
        word = ("abaab" * 8)[:n].encode()
        got = language_id.forward(language_id.Strings([b"b", word]), model)[1]
        for k in range(2):
            total = [1.0] + [0.0] * n
            for end, (i, piece) in itertools.product(range(1, n + 1), enumerate(pieces)):
                if end >= len(piece) and word[end - len(piece) : end] == piece:
                    total[end] += total[end - len(piece)] * p[i, k]
            assert got[k] == pytest.approx(math.log(total[n]))


def test_expected_counts_over_all_segmentations():
    """Forward-backward against a sum over every segmentation, and on a word far longer than a float's range allows unscaled."""
    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    hashes = language_id._piece_hashes(pieces)
    order = np.argsort(hashes)
    p = np.array([[0.3], [0.2], [0.2], [0.2], [0.1]])
    model = language_id.PieceModel(["x"], hashes[order], [1, 2, 3], np.vstack((p[order], np.zeros((1, 1)))))

    def segmentations(word):
        if not word:
            yield []
        for i, piece in enumerate(pieces):
            if word.startswith(piece):
                for rest in segmentations(word[len(piece) :]):
                    yield [i, *rest]

    word, want, total = b"abaabab", np.zeros(5), 0.0
    for cut in segmentations(word):
        weight = np.prod([p[i, 0] for i in cut])
        total += weight
        for i in cut:
            want[i] += weight
    got = language_id._expectation([word, b"ab" * 5000], np.array([[3.0], [0.0]]), model)[:-1, 0]
    assert got == pytest.approx(3 * (want / total)[order])
    long = language_id._expectation([b"ab" * 5000], np.array([[1.0]]), model)[:-1, 0]
    assert np.isfinite(long).all() and (long[np.argsort(order)] @ [1, 1, 2, 2, 3]) == pytest.approx(10000)


def test_vocabulary_is_whole():
    pieces = language_id.vocabulary(VOCABULARY)
    assert max(map(len, pieces)) > 20 and len(pieces) > 35_000
    assert language_id._parts("é".encode() * 300) == ["é".encode() * 128, "é".encode() * 128, "é".encode() * 44]


def test_language_accuracy(spark):
    got = op1_language_id(spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id")
    share = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.95


def test_language_edges(spark, docs):
    model = language_id.fit(table(spark, SMALL, "documents"), VOCABULARY, per_language=20, rounds=1)
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, "the and with " * 2000), (5, "日本語"), (6, "x" * 20000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs(rows, extra=True), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] != "und"
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = language_id.fit(docs([]), VOCABULARY)
    assert [r["lang_pred"] for r in language_id.predict(docs(rows), nothing).collect()] == ["und"] * 6


def test_toxicity_ranks(spark):
    got = op4_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out")
    share = got.groupBy("toxic").agg(F.avg("predicted")).orderBy("toxic").collect()
    assert share[0][1] < 0.02 and share[1][1] > 0.8


def test_toxicity_learns_pairs(spark, docs):
    """Two terms that are harmless alone and toxic together."""
    rows, labels = [], []
    for k in range(800):
        a, b = k & 1, k >> 1 & 1
        rows.append((k, f"filler{k % 7} " + ("slur " if a else "calm ") + ("group" if b else "thing")))
        labels.append((k, a & b))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels, epochs=30)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.flag(docs(rows), model).collect()}
    assert sum(got[k] == (k & 1 & k >> 1) for k in got) > 0.97 * len(got)
    edge = {r["doc_id"]: r["score"] for r in toxicity.score(docs([(1, None), (2, ""), (3, "!!")], extra=True), model).collect()}
    assert edge[1] == edge[2] == edge[3] and 0 <= edge[1] <= 1
    one_kind = toxicity.fit(docs(rows), labels.withColumn("toxic", F.lit(0)))
    assert {r["predicted"] for r in toxicity.flag(docs(rows), one_kind).collect()} == {0}
    assert toxicity.below(docs([]), model).count() == 0


def test_toxicity_learns_rare_pairs(spark, docs):
    """Two terms in 4 % of the rows each, as often toxic alone as not; only both together are toxic."""
    rows, labels = [], []
    for k in range(6000):
        a, b = k % 50 in (0, 1), k % 50 in (1, 2)
        both = a and b
        rows.append((k, f"filler{k % 97} words{k % 31} " + ("slur " if a else "calm ") + ("group" if b else "thing")))
        labels.append((k, int(both)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels, epochs=60)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.flag(docs(rows), model).collect()}
    assert all(got[k] == int(k % 50 == 1) for k in got)


def test_quality_paths_agree(spark):
    documents, trusted = table(spark, SMALL, "documents"), table(spark, SMALL, "labels").where("quality = 1")
    a = {r["doc_id"]: r for r in quality.judged(documents, trusted).collect()}
    b = {r["doc_id"]: r for r in quality.judged(documents, trusted, in_workers_bytes=0).collect()}
    assert set(a) == set(b) and all(abs(a[k]["log_perplexity"] - b[k]["log_perplexity"]) < 1e-5 for k in a)
    good = [r["doc_id"] for r in trusted.collect()]
    bad = [r["doc_id"] for r in table(spark, SMALL, "labels").where("quality = 0").collect()]
    assert sum(a[k]["kept"] for k in good) >= 0.97 * len(good) and sum(a[k]["kept"] for k in bad) <= 0.1 * len(bad)


def test_probabilities_sum_to_one(spark, docs):
    from ravelin.llm.lake import Scratch

    found = quality.tables(docs([(1, "abracadabra abra"), (2, "cadabra")]), Scratch(spark))
    model = quality.gathered(found).prepared()
    for context in (b"abra", b"zzzz", b"\0\0\0\0"):
        keys = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.int64)
        assert np.exp(model.log_probability(keys)).sum() == pytest.approx(1, abs=1e-6)


def test_quality_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "some text " * 50), (4, "some text")]
    trusted = spark.createDataFrame([(3,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality.judged(docs(rows, extra=True), trusted).collect()}
    assert got[1]["log_perplexity"] is None and not got[1]["kept"] and not got[2]["kept"] and got[3]["kept"]
    nothing = {r["doc_id"]: r for r in quality.judged(docs(rows), trusted.limit(0)).collect()}
    assert nothing[3]["kept"] and nothing[3]["log_perplexity"] is None
    assert quality.judged(docs([]), trusted).count() == 0


def test_rows_that_repeat_have_no_id_or_are_long(spark):
    """Language, toxicity and quality: one result for each row, equal ones for equal rows, whatever the extra columns are called."""
    from tests.llm.conftest import text_of

    schema = "doc_id long, text string, lang string, score double, lang_pred string, held_out boolean, threshold double, kept boolean, n_bytes long, toxic int, ids int, unit int, key int"
    long = "the and with " * 40_000 + text_of(1, 20_000)
    base = [(1, None), (2, ""), (3, long), (3, long), (3, "short"), (None, "the and with"), (None, None)]
    documents = spark.createDataFrame([(i, t, None, 0.5, "x", True, 1.0, True, 7, 1, 1, 1, 1) for i, t in base], schema)
    known = table(spark, SMALL, "documents")
    language = language_id.fit(known, VOCABULARY, per_language=20, rounds=1)
    toxic = toxicity.fit(known, table(spark, SMALL, "labels"))
    for got, fields in (
        (language_id.predict(documents, language), ("lang_pred", "score")),
        (toxicity.score(documents, toxic), ("score",)),
        (quality.judged(documents, spark.createDataFrame([(3,), (None,)], "doc_id long")), ("n_bytes", "log_perplexity", "threshold", "kept")),
    ):
        rows = got.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in base)
        threes = [tuple(r[f] for f in fields) for r in rows if r["doc_id"] == 3]
        assert len(set(threes)) == 2 and max(threes.count(x) for x in threes) == 2
    assert language_id.predict(documents.limit(0), language).count() == toxicity.score(documents.limit(0), toxic).count() == 0


def test_equal_languages_tie_to_the_first(spark, docs):
    """Languages learned from the same text score alike; the one that sorts first is told."""
    known = docs([(k, "aa bb cc dd") for k in range(40)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "zz").otherwise("aa"))
    model = language_id.fit(known, VOCABULARY, per_language=100)
    model.probabilities[:, 1] = model.probabilities[:, 0]
    got = language_id.predict(docs([(1, "bb aa")]), model).first()
    assert got["lang_pred"] == "aa" and got["score"] == pytest.approx(0.5)


def test_held_out_share(spark):
    assert 0.2 < table(spark, SMALL, "documents").agg(F.avg(held_out().cast("int"))).first()[0] < 0.3
