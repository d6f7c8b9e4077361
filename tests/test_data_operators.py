"""Writes, sync, time, metadata, paging, streaming and changes on small tables."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from ravelin.engine import Engine
from ravelin.errors import QueryError
from ravelin.operators import changes, hierarchy, merge, temporal, writes
from ravelin.sources import csdl
from ravelin.streaming import events
from tests.conftest import SMALL
from tests.fixtures import marina


def rows(df, *by):
    return sorted(tuple(r) for r in (df.select(*by) if by else df).collect())


def test_upsert_fills_gaps(spark):
    s = marina().set("Rates")
    delta = {"key": {"Berth": "east"}, "start": "2023-06-01T00:00:00", "end": "2023-11-01T00:00:00", "values": {"Amount": 99}}

    def slices(df, berth):
        return [(r["Amount"], str(r["Since"])[:10], str(r["Until"])[:10]) for r in df.where(F.col("Berth") == berth).orderBy("Since").collect()]

    out = temporal.upsert(s.load(spark), s.timeline, [delta])
    first = [(40, "2023-01-01", "2023-04-01"), (60, "2023-04-01", "2023-06-01")]
    assert slices(out, "east") == [*first, (99, "2023-06-01", "2023-07-01"), (99, "2023-07-01", "2023-10-01"), (99, "2023-10-01", "2023-11-01"), (75, "2023-11-01", "None")]
    assert slices(out, "west") == [(20, "2023-01-01", "None")]
    new = temporal.upsert(s.load(spark), s.timeline, [delta | {"key": {"Berth": "north"}}])
    assert slices(new, "north") == [(99, "2023-06-01", "2023-11-01")]
    with pytest.raises(QueryError):
        temporal.upsert(s.load(spark), s.timeline, [delta | {"key": {}}])
    # Several deltas apply in order; the plan of one does not hold that of those before.
    many = [delta | {"start": f"2023-{m:02d}-01T00:00:00", "end": f"2023-{m:02d}-15T00:00:00", "values": {"Amount": m}} for m in range(1, 7)]
    got = slices(temporal.upsert(s.load(spark), s.timeline, [*many, delta | {"key": {"Berth": "north"}}]), "east")
    assert [x for x in got if x[0] < 10] == [(m, f"2023-{m:02d}-01", f"2023-{m:02d}-15") for m in range(1, 7)] and len(got) == 13


def test_store_publishes_all_or_nothing(spark, tmp_path):
    store = writes.Store(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    store.change_set([lambda s: s.stage("A", a), lambda s: s.stage("B", a.limit(1))])
    assert rows(store.read("A")) == [(1, "x"), (2, "y")]

    def broken(s):
        writes.validate(a, [writes.in_range("id", 5, 9)])

    with pytest.raises(QueryError):
        store.change_set([lambda s: s.stage("A", a.limit(0)), broken])
    assert store.read("A").count() == 2
    store.change_set([lambda s: s.stage("A", writes.delete(s.read("A"), F.col("id") == 1))])
    assert rows(store.read("A")) == [(2, "y")]


def test_pointer_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    """The pointer file is there at every moment of a publication."""
    store = writes.Store(spark, str(tmp_path))
    a = spark.createDataFrame([(1,)], "id int")
    store.change_set([lambda s: s.stage("A", a)])
    seen = []
    fs = store._fs(str(tmp_path))[0]
    monkeypatch.setattr(type(fs), "delete", lambda *x: seen.append("deleted"), raising=False)
    store.change_set([lambda s: s.stage("A", a.limit(0))])
    assert not seen and store.read("A").count() == 0
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("current") and p.name != "current.json"] == []


def test_deep_chain_is_whole(spark):
    """No depth ends a hierarchy early."""
    from ravelin.sources.model import EntityModel, EntitySet, Hierarchy

    model = EntityModel()
    chain = EntitySet("Links", "Link", ("Id",), lambda s: s.range(1, 61).select(F.col("id").cast("int").alias("Id"), F.when(F.col("id") > 1, F.col("id") - 1).cast("int").alias("Up")))
    chain.hierarchies["Chain"] = Hierarchy("Id", "Up")
    model.add(chain)
    engine = Engine(spark, model)
    assert not hasattr(hierarchy, "DEEPEST")
    assert engine.query("Links?$apply=descendants($root/Links,Chain,Id,Id eq 1,keep start)").count() == 60
    assert [r[0] for r in engine.query("Links?$apply=traverse($root/Links,Chain,Id,preorder)&$select=Id").collect()] == list(range(1, 61))


def test_top_slices(spark):
    """Slices of the value order: as many as the rows need, and a value that all rows share is cut too."""
    from ravelin.operators import select_top

    df = spark.range(4000).select("id", F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).cast("long").alias("v"))
    for rows_per_slice in (100, 10**6):
        got, before, total = select_top.ordered_prefix(df, F.col("v"), True, ["id"], [], rows_per_slice)
        order = sorted(((r["v"], r["id"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
        want, run = {}, 0
        for v, i in order:
            want[i] = run
            run += v
        assert {r["id"]: r[before] for r in got.collect()} == want and got.select(total).first()[0] == run
        ranked, at, _ = select_top.ordered_rank(df, F.col("v"), False, ["id"], rows_per_slice)
        assert [r["id"] for r in ranked.orderBy(at).collect()] == [i for _, i in sorted((v, i) for v, i in order)]


def test_levels_end_at_the_object_itself(spark):
    """A cycle 1 -> 2 -> 3 -> 1 and a tail 4: each is shown inside its own path, but not expanded again."""
    from ravelin.sources.model import EntityModel, EntitySet, Nav

    model = EntityModel()
    model.add(EntitySet("Rings", "Ring", ("Id",), lambda s: s.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 2)], "Id int, Up int"), (Nav("Next", "Rings", (("Id", "Up"),), True), Nav("Prior", "Rings", (("Up", "Id"),)))))
    engine = Engine(spark, model)

    def tree(row, nav):
        below = row[nav] if nav in row and row[nav] is not None else None
        return (row["Id"], None if below is None else [tree(x, nav) for x in below] if isinstance(below, list) else tree(below, nav))

    deep = {r["Id"]: tree(r.asDict(True), "Next") for r in engine.query("Rings?$expand=Next($levels=max;$select=Id)&$select=Id").collect()}
    assert deep[1] == (1, [(2, [(3, [(1, None)]), (4, [])])]) and deep[4] == (4, [])
    two = {r["Id"]: tree(r.asDict(True), "Next") for r in engine.query("Rings?$expand=Next($levels=2;$orderby=Id desc;$select=Id)&$select=Id").collect()}
    assert two[1] == (1, [(2, [(4, None), (3, None)])]) and two[4] == (4, [])
    up = {r["Id"]: tree(r.asDict(True), "Prior") for r in engine.query("Rings?$expand=Prior($levels=max;$select=Id)&$select=Id").collect()}
    assert up[4] == (4, (2, (1, (3, (2, None))))) and up[1] == (1, (3, (2, (1, None))))


def test_write_checks(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "y", None)], "id int, v string, n int")
    with pytest.raises(QueryError) as e:
        writes.insert(a, a.limit(1), ("id",))
    assert e.value.status == 409
    with pytest.raises(QueryError):
        writes.update(a, F.col("id") == 1, {"id": 3}, ("id",))
    with pytest.raises(QueryError):
        writes.check_references(a, "n", a, "id")
    tag = a.where("id = 1").select(writes.etag(["v", "n"])).first()[0]
    writes.check_etag(a, F.col("id") == 1, ["v", "n"], tag)
    with pytest.raises(QueryError) as e:
        writes.check_etag(a, F.col("id") == 2, ["v", "n"], tag)
    assert e.value.status == 412
    writes.validate(a, [writes.multiple_of("n", 5), writes.matching("v", "^[xy]$")])
    parents, children = writes.deep_insert(a, spark.createDataFrame([(1, 1)], "cid int, pid int"), spark.createDataFrame([(None, "z", 1)], "id int, v string, n int"), spark.createDataFrame([(None, None)], "cid int, pid int"), "id", "cid", "pid")
    assert rows(parents, "id") == [(1,), (2,), (3,)]
    assert rows(children) == [(1, 1), (2, 3)]


@pytest.mark.parametrize("rule", ["remote", "local", "last_writer", "fields"])
def test_every_conflict(spark, rule):
    """All combinations of absent, unchanged and changed rows on both sides."""
    states = {"gone": None, "same": ("a", "a", "1"), "x": ("b", "a", "3"), "y": ("a", "c", "2")}
    cases = list(itertools.product(states, states))
    make = lambda k: spark.createDataFrame([(i, *states[pair[k]]) for i, pair in enumerate(cases) if states[pair[k]]], "id int, f string, g string, stamp string")
    base = spark.createDataFrame([(i, *states["same"]) for i in range(len(cases))], "id int, f string, g string, stamp string")
    got = {r["id"]: r for r in merge.three_way(base, make(0), make(1), ["id"], rule, "remote", "stamp").collect()}
    for i, (mine, theirs) in enumerate(cases):
        r = got[i]
        if theirs == "same":
            want = states[mine]
        elif mine in ("same", theirs):
            want = states[theirs]
        elif rule == "remote":
            want = states[theirs]
        elif rule == "local":
            want = states[mine]
        elif rule == "last_writer":
            want = states[mine] if theirs == "gone" or (mine != "gone" and states[mine][2] > states[theirs][2]) else states[theirs]
        else:
            want = states[theirs] if "gone" in (mine, theirs) else ("b", "c", "3")
        assert (None if r["_outcome"] == "deleted" else (r["f"], r["g"], r["stamp"])) == want, (mine, theirs)


def test_peers_converge(spark):
    base = spark.createDataFrame([(1, "a", "1")], "id int, f string, stamp string")
    one, two = (spark.createDataFrame([(1, f, "5")], base.schema) for f in "xy")
    here = merge.three_way(base, one, two, ["id"], "last_writer", stamp="stamp", peers=True).first()["f"]
    there = merge.three_way(base, two, one, ["id"], "last_writer", stamp="stamp", peers=True).first()["f"]
    assert here == there


def test_clock():
    clock = merge.Clock("r1")
    a, b = clock.tick(100), clock.tick(100)
    assert a < b and len(a) == 16 + 1 + 4 + 1 + 8
    clock.receive("0000000000000500.0003.00000009", 120)
    assert clock.tick(120) > "0000000000000500.0003.00000009"


def test_changes_and_tokens(spark):
    log = spark.createDataFrame([(1, "a", 1, "insert"), (1, "b", 2, "update"), (2, "c", 3, "insert"), (2, None, 4, "delete"), (3, "d", 5, "insert")], "id int, v string, _version int, _op string")
    assert rows(changes.log_changes(log, ["id"], 1), "id", "_change") == [(1, "updated"), (2, "deleted"), (3, "inserted")]
    with pytest.raises(QueryError) as e:
        changes.DeltaToken(3).check(5, 9)
    assert e.value.status == 410


def test_metadata_round_trip(spark):
    model = marina()
    document = csdl.metadata(spark, model)
    again = csdl.from_xml(csdl.to_xml(document))
    entity = again["Default"]["Boat"]
    assert entity["$Key"] == ["Hull"] and entity["Length"]["$Scale"] == 2 and entity["Harbour"]["$ReferentialConstraint"] == {"HarbourId": "HarbourId"}
    read = csdl.model_of(csdl.to_xml(document), {n: s.load for n, s in model.sets.items()})
    assert Engine(spark, read).query("Boats?$filter=Harbour/City eq 'Ostend'").count() == 2
    assert csdl.schema_of(entity, again)["Length"].dataType.simpleString() == "decimal(8,2)"
    assert read.enums["Lamps"].flags


def test_pages_cover_all(spark):
    engine = Engine(spark, marina())
    for url in ("Boats?$select=Title", "Boats?$orderby=Length desc&$select=Hull", "Boats?$top=5&$count=true"):
        seen, link = 0, url
        while link:
            page = engine.page(link, 3)
            seen, link = seen + page.rows.count(), page.next_link
        assert seen == (5 if "top" in url else 7)
    assert engine.page("Boats?$count=true&$top=0", 4).count == 7
    assert engine.page("Boats", 7, max_bytes=1).rows.count() == 1


def test_visibility(spark):
    model = marina()
    model.set("Boats").visible = lambda df: F.col("Sold") == False  # noqa: E712
    engine = Engine(spark, model)
    assert engine.query("Boats").count() == 3
    assert engine.query("Harbours?$filter=Boats/$count eq 2").select("HarbourId").first()[0] == 10


def test_batch(spark):
    answers = Engine(spark, marina()).batch(["Boats/$count", "Nope"])
    assert answers[0].first()[0] == 7 and answers[1].status == 404


def test_streamed_windows_equal_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet")
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.event_stream(spark, str(tmp_path / "in"), table.schema), "1 day", "3650 days")
    query = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = table.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    assert spark.table("w").agg(F.sum("n")).first()[0] == table.count()
    assert spark.table("w").count() == batch.count()


def test_pushdown(spark):
    from ravelin.sources.catalog import table_model

    engine = Engine(spark, table_model(SMALL))
    plan = engine.query("Orders?$filter=Totalprice gt 100000&$select=Orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000" in plan and "o_orderstatus" not in plan.split("ReadSchema")[1]


def test_remote_collection(spark, tmp_path):
    import json

    from ravelin.sources import remote

    (tmp_path / "1.json").write_text(json.dumps({"value": [{"a": 1, "b": "x"}, {"a": 2}], "@odata.nextLink": "2.json"}))
    (tmp_path / "2.json").write_text(json.dumps({"value": [{"a": 3, "b": "z"}]}))
    remote.register(spark)
    read = lambda **o: spark.read.format("remote_collection").schema("a int, b string").options(url=f"file://{tmp_path}/1.json", **o).load()
    assert rows(read(), "a") == [(1,), (2,), (3,)]
    assert read(limit="2").count() == 2


def test_submitted_requests(spark):
    engine = Engine(spark, marina())
    job = engine.submit("Boats/$count")
    assert job.result(120)[0][0] == 7
    with pytest.raises(QueryError):
        engine.submit("Nope").result(120)
