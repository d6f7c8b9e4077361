"""Decontamination, WARC, URL filters and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import decontamination, neighbours, url_filters, warc
from ravelin.llm.lake import table
from ravelin.llm.queries import RULES, op3_decontamination
from tests.conftest import SMALL
from tests.llm.conftest import text_of

QUESTION = "A farmer named Ann has 12 kg of apples and gives Bob exactly 5 kg before noon. How many apples does Ann still have to sell at the market today?"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_reparameterised(spark, docs, broadcast):
    changed = QUESTION.replace("Ann", "Zoe").replace("Bob", "Max").replace("12 kg", "30 lb").replace("5 kg", "7 lb")
    mixed = changed.replace("does Zoe", "does Max")
    rows = [(1, QUESTION), (2, f"{text_of(1, 20)}. {changed} {text_of(2, 9)}"), (3, QUESTION.upper()), (4, text_of(3, 90)), (5, None), (6, ""), (7, QUESTION[:50]), (8, mixed.replace("7 lb", "30 lb"))]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.leaks(docs(rows, extra=True), items(spark, [(9, QUESTION), (10, None), (11, "too short"), (9, QUESTION)]), broadcast_bytes=broadcast).collect()}
    assert {k for k in got} >= {(1, 9), (2, 9)} and not {(4, 9), (5, 9), (6, 9), (7, 9)} & set(got)
    assert got[1, 9] is False and got[2, 9] is True and (8, 9) not in got


def found(spark, docs, texts, rows):
    """Pairs (document number, item id) that leak."""
    got = decontamination.leaks(docs(list(enumerate(texts))), items(spark, rows)).collect()
    return {(r["doc_id"], r["item_id"]) for r in got}


def test_names_anywhere(spark, docs):
    """The docstring's example, capitals, names of other shapes, and a second name that is another."""
    item = "Ann has 3 kg of red apples. McDonald gives two more to Ann before O'Brien comes home in the evening."
    good = item.replace("Ann", "Bob").replace("3 kg", "7 lb").replace("McDonald", "Zed").replace("O'Brien", "Smith")
    texts = [good, item.upper(), item.lower(), good.replace("to Bob", "to Zed"), "nothing of the kind"]
    assert found(spark, docs, texts, [(1, item)]) == {(0, 1), (1, 1), (2, 1)}
    assert found(spark, docs, ["Bob has 7 lb of red apples."], [(1, "Ann has 3 kg of red apples.")]) == {(0, 1)}


def test_texts_under_one_item(spark, docs):
    first, second = QUESTION, "Which of these rivers flows through four capitals before it reaches the sea?"
    assert found(spark, docs, [first, second], [(1, first), (1, second), (1, None)]) == {(0, 1), (1, 1)}


def test_windows_slots_and_coverage_by_brute_force(spark, docs):
    """Lower-case texts (one reading): windows, matches, consistency and coverage by definition."""
    import itertools
    import random

    r = random.Random(8)
    vocabulary = "red green apples pears gives sells buys many before after noon market farm road".split()
    token = lambda: r.choice([r.choice(vocabulary)] * 4 + [str(r.randrange(3)), r.choice(["kg", "lb"])])
    benchmark = [(k, " ".join(token() for _ in range(r.randrange(4, 20)))) for k in range(12)]
    texts = []
    for k, (_, t) in enumerate(benchmark):
        w = [str(r.randrange(3)) if x.isdigit() and k % 2 else x for x in t.split()]
        texts += [t, " ".join([*(token() for _ in range(6)), *w, token()]), " ".join(w[: len(w) // 2 + 3])]
    kind = lambda x: "#" if x.isdigit() else "u" if x in ("kg", "lb") else ""
    size, least = decontamination.WINDOW, decontamination.SHORTEST

    def keys(words, n):
        for at in range(len(words) - n + 1):
            w = words[at : at + n]
            literal = sum(not kind(x) for x in w)
            yield at, tuple(kind(x) or x for x in w) if literal >= least else ("exact", *w), literal >= least, w

    want = {}
    for (d, text), (i, item) in itertools.product(enumerate(texts), benchmark):
        words, n = text.split(), min(size, len(item.split()))
        mine = list(keys(item.split(), n))
        shifts: dict[int, list] = {}
        for at, key, template, w in keys(words, n):
            for place, other, _, own in mine:
                if key == other:
                    slots = {(a, b) for a, b in zip(own, w, strict=True) if kind(a)} if template else set()
                    shifts.setdefault(at - place, []).append((place, template, slots))
        covered = set()
        for hits in shifts.values():
            slots = set().union(*(x[2] for x in hits))
            if len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots}):
                covered |= {(place, template) for place, template, _ in hits}
        templates = sum(x[2] for x in mine)
        share = max(len(covered) / len(mine), sum(t for _, t in covered) / templates if templates else 0)
        if covered and share >= decontamination.MIN_COVERAGE:
            want[d, i] = (len(mine), len(covered), round(share, 6))
    got = decontamination.leaks(docs(list(enumerate(texts))), items(spark, benchmark)).collect()
    assert {(x["doc_id"], x["item_id"]): (x["windows"], x["matched"], x["coverage"]) for x in got} == want and len(want) > 12


def test_long_text_and_missing_ids(spark, docs):
    rows = [(1, f"{text_of(4, 60_000)} {QUESTION} {text_of(5, 10)}"), (None, QUESTION), (2, QUESTION), (2, QUESTION)]
    got = decontamination.leaks(docs(rows), items(spark, [(7, QUESTION), (None, QUESTION)])).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 7), (2, 7)]


def test_verbatim_items_are_found(spark):
    documents, benchmark = table(spark, SMALL, "documents").toPandas(), table(spark, SMALL, "benchmark").toPandas()
    fold = lambda t: " ".join((t or "").lower().split())
    want = {(i, j) for i, t in zip(documents.doc_id, documents.text, strict=True) for j, x in zip(benchmark.item_id, benchmark.text, strict=True) if fold(x) in fold(t)}
    got = {(r["doc_id"], r["item_id"]) for r in op3_decontamination(spark, SMALL).collect()}
    assert want and got == want


def test_decontamination_empty(spark, docs):
    assert decontamination.leaks(docs([]), items(spark, [(1, QUESTION)])).count() == 0
    assert decontamination.clean(docs([(1, QUESTION)]), items(spark, [])).count() == 1


def test_url_rules(spark):
    urls = ["http://Example.COM/en/71?x", "https://a.example.com/en/8", "http://net/de/8", "http://x.example.net/de/88#f", "http://notexample.net/de/8", "http://org/es", "http://org/es/", None, "no url", "x://", "http://com/fr/", "http://b.com/en/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, url_filters.rules_frame(spark, RULES)).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "allow"), 5: (None, "allow"), 6: ("org/es/", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: ("com/en/", "block")}
    assert url_filters.judge(pages.limit(0), url_filters.rules_frame(spark, RULES)).count() == 0
    assert url_filters.judge(pages, url_filters.rules_frame(spark, RULES).limit(0)).where("verdict = 'allow'").count() == len(urls)


def test_long_hosts_and_ties(spark):
    """The expansion of a host grows with its labels, and equal rules have one outcome."""
    host = ".".join(["a"] * 30_000) + ".com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (1, f"http://{host}/en/x"), (2, "http://com/en/"), (3, "http://com:80/en/")], "page_id long, url string")
    rules = url_filters.rules_frame(spark, [("block", "com", "/en/"), ("allow", "com", "/en/"), ("allow", "a.com", "/en/"), ("block", "b.com", "/en/")])
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules).collect())
    assert got[:3] == [(1, "a.com/en/", "allow"), (1, "a.com/en/", "allow"), (2, "com/en/", "block")] and got[3][2] == "allow"


def test_revisits(spark):
    t = "2024-01-01 0{}:00:00"
    rows = [
        (1, "response", "http://www.A.com/x/?utm_source=q", t.format(1), "e1", None, {"Content-Length": "9", "X": "old"}, 1, "d1"), (2, "response", "https://a.com/x#f", t.format(3), "e2", None, {"Content-Length": "8"}, 2, "d2"),
        (3, "revisit", "http://a.com/x", t.format(2), "e1", None, {"content-length": "0", "x": "new"}, None, None), (4, "revisit", "http://a.com/x", t.format(4), "e1", None, None, None, None), (5, "revisit", "http://a.com/x", t.format(5), None, None, None, None, None),
        (6, "revisit", "http://a.com/y", t.format(5), "e1", None, None, None, None), (7, "revisit", None, None, None, None, None, None, None), (8, "revisit", "http://a.com/x", t.format(3), "e2", None, None, None, None),
    ]
    log = spark.createDataFrame(rows, "record_id long, kind string, url string, captured string, etag string, last_modified string, headers map<string,string>, payload_ref long, payload_digest string").withColumn("captured", F.col("captured").cast("timestamp_ntz")).withColumn("base", F.lit(1))
    for seconds in (60, 3600, 10**8):
        got = {r["record_id"]: r for r in warc.resolve_revisits(log, seconds).collect()}
        assert {k: r["status"] for k, r in got.items()} == {1: "full", 2: "full", 3: "resolved", 4: "mismatch", 5: "unvalidated", 6: "orphan", 7: "orphan", 8: "resolved"}
        assert got[3]["headers"] == {"content-length": "9", "x": "new"} and got[3]["payload_digest"] == "d1" and got[8]["resolved_id"] == 2
    assert warc.resolve_revisits(log.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    data = warc.write_record("response", "http://a/", "2024-01-01T00:00:00Z", {"ETag": "e"}, b"hello") + warc.write_record("revisit", "http://a/", "2024-01-01T01:00:00Z", {"ETag": "e"}, b"", "304 Not Modified")
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "b.warc").write_bytes(data[:-60])
    rows = warc.read_warc(spark, str(tmp_path))
    assert rows.where("kind <> 'torn'").count() == 3 and rows.where("kind = 'torn'").count() == 1 and rows.where("kind = 'response'").select("payload").first()[0] == b"hello"
    assert sorted(r["status"] for r in warc.resolve_revisits(rows.where("file LIKE '%gz'")).collect()) == ["full", "resolved"]


def test_warc_dates_profiles_and_torn_records(spark, tmp_path):
    import gzip

    same = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    dates = ["2024-01-01T00:00:00.123Z", "", "2024-01", "soon", "2024-01-01T02:00:00Z"]
    records = [warc.write_record("response" if k < 4 else "revisit", f"http://a/{k}" if k < 4 else "http://a/0", d, {"ETag": "e", "X": str(k)}, b"hello" if k in (0, 4) else b"x", profile=same if k == 4 else None) for k, d in enumerate(dates)]
    torn = records[1][:90] + b"\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join([records[0], torn, *records[1:]]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(records[2]) + b"\x1f\x8b\x08broken" + gzip.compress(records[3]))
    rows = warc.read_warc(spark, str(tmp_path))
    told = sorted((r["url"] or "", str(r["captured"]), r["kind"]) for r in rows.where("file LIKE '%a.warc'").collect())
    assert [x for x in told if x[2] != "torn"] == [("http://a/0", "2024-01-01 00:00:00.123000", "response"), ("http://a/0", "2024-01-01 02:00:00", "revisit"), ("http://a/1", "None", "response"), ("http://a/2", "2024-01-01 00:00:00", "response"), ("http://a/3", "None", "response")]
    assert sum(x[2] == "torn" for x in told) == 1 and rows.where("file LIKE '%gz'").count() == 2
    again = {r["status"]: r for r in warc.resolve_revisits(rows.where("file LIKE '%a.warc' AND url = 'http://a/0' AND kind <> 'torn'")).collect()}
    assert again["resolved"]["headers"]["x"] == "4" and again["resolved"]["base_id"] == again["full"]["record_id"]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1500, 12)).astype(np.float32)
    m[100:400] = m[100]  # one vector that many rows have
    rows = [(int(i), m[i].tolist(), 0) for i in range(len(m))] + [(5000, None, 0), (5001, [0.0] * 12, 0), (5002, [float("nan")] * 12, 0), (5003, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, d int")
    got = neighbours.nearest(df, lambda v: v % 50 == 0).toPandas()
    exact = m.astype(np.float64)
    hits = 0
    for q in range(0, len(m), 50):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(m)), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine.score, d[mine.vec_id])
        hits += len(set(want) & set(mine.vec_id))
    assert hits >= 0.9 * 10 * 30 and set(got.query_id) == set(range(0, 1500, 50))


def test_neighbours_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema), lambda v: v >= 0).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0, 2.0])], schema), lambda v: v >= 0).count() == 0
    two = neighbours.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 6.0])], schema), lambda v: v >= 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in two) == [(1, 1, 2, 0.0), (1, 2, 3, 5.0), (2, 1, 1, 0.0), (2, 2, 3, 5.0), (3, 1, 1, 5.0), (3, 2, 2, 5.0)]


def test_graph_settles(spark, tmp_path):
    """Unclustered vectors in many blocks: descents must go on until the links hardly change."""
    from ravelin.llm.lake import Scratch

    m = np.random.default_rng(11).normal(size=(12000, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    scratch = Scratch(spark)
    nodes = scratch.keep(spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "node long, v array<double>"), "nodes")
    graph = neighbours.build(nodes, scratch).where("node % 100 = 0").toPandas()
    hits = 0
    for q in range(0, len(m), 100):
        d = ((m - m[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(graph[graph.node == q].others.iloc[0]))
    assert hits >= 0.95 * 10 * 120


def test_neighbours_of_many_blocks(spark):
    """Recall of the whole search on 12,000 unclustered vectors, some 30 blocks a tree; negative and repeated ids."""
    rng = np.random.default_rng(12)
    m = rng.normal(size=(12000, 24)).astype(np.float32)
    ids = np.arange(12000) - 6000
    ids[7] = ids[8]  # one id, two vectors
    rows = [(int(i), v) for i, v in zip(ids, m.tolist(), strict=True)] + [(None, m[0].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), lambda v: v % 200 == 0).toPandas()
    exact, hits, asked = m.astype(np.float64), 0, [i for i in ids if i % 200 == 0]
    for q in asked:
        d = np.sqrt(((exact - exact[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.argsort(d)[:10]]) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.95 * 10 * len(asked) and (got.groupby("query_id").vec_id.nunique() == 10).all()


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_names_in_any_place_and_case(spark, docs, broadcast):
    tom = "Tom has 12 kg of apples. Tom gives 5 kg to Ann. Tom buys 3 more kg today. How many kg does Tom have now?"
    rows = [(1, tom.replace("Tom", "Max").replace("Ann", "Zoe")), (2, QUESTION.upper()), (3, QUESTION.lower()), (4, tom.upper())]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.leaks(docs(rows), items(spark, [(8, tom), (9, QUESTION)]), broadcast_bytes=broadcast).collect()}
    assert got == {(1, 8): True, (2, 9): False, (3, 9): False, (4, 8): False}


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_items_without_literals(spark, docs, broadcast):
    sort = "Sort 3, 8, 1, 9, 4, 7, 2 and 6 in order: 1 2 3 4 6 7 8 9"
    rows = [(1, f"{text_of(1, 20)} {sort} {text_of(2, 9)}"), (2, sort.translate(str.maketrans("123456789", "234567891"))), (3, "We know 7 x 8 by heart"), (4, "7 x 9")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(rows), items(spark, [(8, sort), (9, "7 x 8")]), broadcast_bytes=broadcast).collect()}
    assert got == {(1, 8), (3, 9)}
