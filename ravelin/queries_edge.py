"""More registered queries: derived types, nulls, refusals, writes and sync, each with independent SQL.

``Goods`` is a view of ``part`` with nulls, a complex property, a derived type
and a stream, so that both null regimes show in the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.builder import Query, field
from ravelin.engine import Engine
from ravelin.errors import QueryError
from ravelin.operators import changes, merge, temporal, writes

from ravelin.plans.parser import parse_expression
from ravelin.queries import QUERIES, SQL, _STATES, engine, shaped
from ravelin.sources import csdl
from ravelin.sources.model import EntitySet, Nav, Overloads

GOODS = """(SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS size,
  p_type = 'PROMO' AS promo, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS city, CASE WHEN p_partkey % 6 <> 0 THEN p_size % 8 END AS marks, p_partkey % 3 = 0 AS bare, p_name FROM part)"""


def _goods(e: Engine) -> Engine:
    load = e.model.set("Parts").load

    def rows(spark: SparkSession) -> DataFrame:
        k = F.col("Partkey")
        when = lambda n, x: F.when(k % n != 0, x)
        return load(spark).select(
            "Partkey", when(5, F.col("Name")).alias("Name"), when(4, F.col("Size")).alias("Size"), F.when(F.col("Type") == "PROMO", "Promo").otherwise("Good").alias("Kind"),
            when(7, F.struct(F.col("Brand").alias("City"), F.col("Type").alias("Zone"))).alias("Address"), when(6, F.col("Size") % 8).alias("Marks"),
            when(3, F.array(F.col("Size"), (k % 10).cast("int"), F.lit(None).cast("int"))).alias("Tags"), F.encode("Name", "utf-8").alias("Data"), F.lit("text/plain").alias("ContentType"),
        )

    goods = EntitySet("Goods", "Good", ("Partkey",), rows, (Nav("Lines", "Lineitems", (("Partkey", "Partkey"),), True, declared_in="Promo"),))
    goods.type_column, goods.subtypes = "Kind", {"Good": ("Good", "Promo"), "Promo": ("Promo",)}
    goods.stream = ("Data", "ContentType")
    e.model.add(goods)
    e.model.functions["Tables.Picked"] = Overloads(
        ({}, lambda engine, frame: frame.with_df(frame.df.where("Partkey <= 3"))),
        ({"upto": int}, lambda engine, frame, upto: frame.with_df(frame.df.where(F.col("Partkey") <= upto))),
        ({"upto": int, "least": float}, lambda engine, frame, upto, least: frame.with_df(frame.df.where((F.col("Partkey") <= upto) & (F.col("Size") >= least)))),
    )
    return e


def request(name: str, url: str, sql: str, names: str | None = None, rounds: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: shaped(_goods(engine(spark, sf_dir)).query(url), names, rounds)
    SQL[name] = sql


def code(name: str, sql: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(_goods(engine(spark, sf_dir)))
        SQL[name] = sql
        return f

    return register


def refused(name: str, **urls: int) -> None:
    """Requests that must fail, each with its status."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, out = _goods(engine(spark, sf_dir)), []
        for url in urls:
            try:
                e.query(url)
                out.append((url, 200))
            except QueryError as x:
                out.append((url, x.status))
        return spark.createDataFrame(out, "request string, status int")

    QUERIES[name] = run
    rows = ", ".join(f"('{u.replace(chr(39), chr(39) * 2)}', {s})" for u, s in urls.items())
    SQL[name] = f"SELECT * FROM (VALUES {rows}) v(request, status)"


# --- sources ---
request("src5_cast_segment", "Goods/Tables.Promo?$select=Partkey,Name", f"SELECT k AS Partkey, name AS Name FROM {GOODS} WHERE promo")
SQL["src10_service_document"] = "SELECT n AS name, 'EntitySet' AS kind, n AS url FROM (VALUES ('Regions'), ('Nations'), ('Customers'), ('Suppliers'), ('Parts'), ('Orders'), ('Lineitems'), ('Events'), ('Documents'), ('Labels'), ('Pages'), ('Benchmark'), ('Conversations'), ('Embeddings'), ('UserStates')) v(n)"
SQL["src15_json"] = """SELECT '{"Name":"' || n_name || '","Region":{"Name":"' || r_name || '"}}' AS value FROM nation JOIN region ON r_regionkey = n_regionkey"""


@code("src12_schema", "SELECT * FROM (VALUES ('Orderkey', 'bigint'), ('Custkey', 'bigint'), ('Orderstatus', 'string'), ('Totalprice', 'double'), ('Orderpriority', 'string')) v(name, type)")
def _(e: Engine) -> DataFrame:
    document = csdl.from_xml(csdl.to_xml(csdl.metadata(e.spark, e.model)))
    found = csdl.schema_of(document["Tables"]["Order"], document)
    return e.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found if f.name != "Orderdate"], "name string, type string")


@code("src13_objects", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice > 400000")
def _(e: Engine) -> DataFrame:
    given = e.model.set("Orders").load(e.spark).where("Orderkey % 2 = 0")
    return e.over(given, "Orders", "$filter=Totalprice gt 400000&$select=Orderkey")


@code("src14_stream", "SELECT p_name AS content, 'text/plain' AS type, sha256(p_name) AS etag FROM part WHERE p_partkey IN (3, 4)")
def _(e: Engine) -> DataFrame:
    both = e.stream_of("Goods(3)").unionByName(e.stream_of("Goods(4)"))
    return both.select(F.decode("content", "utf-8").alias("content"), F.col("content_type").alias("type"), "etag")


@code("src15_envelope", "SELECT '$metadata#Nations(Nationkey)' AS context, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n, n_nationkey AS Nationkey, 'Nations(' || n_nationkey || ')' AS id FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 2")
def _(e: Engine) -> DataFrame:
    found = e.document("Nations?$filter=Regionkey eq 1&$count=true&$select=Nationkey", 2, "full")
    assert "$skiptoken" in found["@odata.nextLink"]
    return e.spark.createDataFrame([(found["@odata.context"], found["@odata.count"], r["Nationkey"], r["@odata.id"]) for r in found["value"]], "context string, n long, Nationkey int, id string")


@code("src17_batch_references", "SELECT '2' AS id, 200 AS status, count(*) AS n FROM orders WHERE o_custkey = 5 UNION ALL SELECT '3', 404, NULL UNION ALL SELECT '4', 424, NULL")
def _(e: Engine) -> DataFrame:
    answers = e.batch_document([{"id": "1", "url": "Customers(5)"}, {"id": "2", "url": "$1/Orders", "dependsOn": ["1"]}, {"id": "3", "url": "Nothing"}, {"id": "4", "url": "Regions", "dependsOn": ["3"]}])
    return e.spark.createDataFrame([(a["id"], a["status"], a["rows"].count() if "rows" in a else None) for a in answers[1:]], "id string, status int, n long")


# --- predicates over nulls ---
for _name, _condition, _sql in (
    ("prj11_complex", "Address/City eq 'Brand#11'", "coalesce(city = 'Brand#11', false)"),
    ("prj11_complex_negated", "not (Address/City eq 'Brand#11')", "NOT coalesce(city = 'Brand#11', false)"),
    ("prj21_cast", "Tables.Promo/Size gt 20", "promo AND coalesce(size > 20, false)"),
    ("prj21_cast_negated", "not (Tables.Promo/Size gt 20)", "NOT (promo AND coalesce(size > 20, false))"),
    ("prj20_isof_derived", "isof(Tables.Promo) and not (Size eq null)", "promo AND size IS NOT NULL"),
    ("prj23_isdefined_path", "isdefined(Address/City) and not isdefined(Address/Street) and Partkey lt 50", "k < 50"),
    ("prj4_null_negated", "not (Size gt 20)", "NOT coalesce(size > 20, false)"),
    ("prj4_null_ne", "Size ne 7", "size IS DISTINCT FROM 7"),
    ("prj6_null_kleene", "not (contains(Name,'cold') or Size gt 25)", "NOT (contains(name, 'cold') OR coalesce(size > 25, false))"),
    ("str1_null_negated", "not contains(Name,'cold')", "NOT contains(name, 'cold')"),
    ("prj7_null_in", "Size in (1,2,null)", "size IN (1, 2) OR size IS NULL"),
    ("prj8_null_has", "not (Marks has 4)", "NOT ((marks & 4) = 4)"),
    ("prj9_null_divide", "Size div (Size mod 5) gt 3", "size % 5 <> 0 AND size // (size % 5) > 3"),
    ("arr1_mod", "Tags/any(t:t mod 7 eq 3)", "NOT bare AND (coalesce((SELECT p_size FROM part WHERE p_partkey = k) % 7 = 3, false) OR (k % 10) % 7 = 3)"),
    ("arr1_div", "Tags/any(t:t div 4 eq 2)", "NOT bare AND ((SELECT p_size FROM part WHERE p_partkey = k) // 4 = 2 OR (k % 10) // 4 = 2)"),
    ("arr1_in_null", "Tags/any(t:t in (9,null)) and Partkey lt 100", "NOT bare AND k < 100"),
):
    request(_name, f"Goods?$filter={_condition}&$select=Partkey", f"SELECT k AS Partkey FROM {GOODS} WHERE {_sql}")


@code("prj29_visible", "SELECT c_custkey AS Custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0) > 5")
def _(e: Engine) -> DataFrame:
    e.model.set("Orders").visible = lambda df: F.col("Orderkey") % 3 == 0
    return e.query("Customers?$filter=Orders/$count gt 5&$select=Custkey")


refused("prj14_refused", **{"Parts?$filter=Size gt $root/Parts(1)/Size": 501, "Parts?$filter=Size eq $root/Nothing": 501})
refused("dat4_refused", **{"Events?$filter=fractionalseconds(Ts) eq 0": 501, "Events?$filter=time(Ts) eq 12:00": 501, "Events?$filter=totaloffsetminutes(Ts) eq 0": 501})
refused("cnd1_refused", **{"Parts?$filter=geo.distance(Name,Brand) lt 3": 501, "Orders?$filter=Orderdate lt maxdatetime()": 501, "Orders?$filter=Orderdate gt mindatetime()": 501})
refused("agg18_refused", **{"Orders?$apply=groupby((rollup(Orderstatus,Custkey)))": 501, "Orders?$apply=aggregate(Totalprice with sum from Custkey as S)": 501})
refused("apl13_refused", **{"Orders?$apply=nest(Items as I)": 501})
refused("exp9_refused", **{"Regions?$expand=Nations($expand=Customers($expand=Orders($expand=Items($expand=Order($expand=Customer($expand=Nation($expand=Region($expand=Nations))))))))": 400})


@code("prj28_restricted", "SELECT * FROM (VALUES ('filter', 400), ('sort', 400), ('group', 400), ('aggregate', 400)) v(request, status)")
def _(e: Engine) -> DataFrame:
    s = e.model.set("Parts")
    s.not_filterable, s.not_sortable, s.not_groupable, s.not_aggregatable = (frozenset({"Brand"}),) * 4
    out = []
    for name, url in (("filter", "Parts?$filter=Brand eq 'x'"), ("sort", "Parts?$orderby=Brand"), ("group", "Parts?$apply=groupby((Brand))"), ("aggregate", "Parts?$apply=aggregate(Brand with max as M)")):
        try:
            e.query(url)
            out.append((name, 200))
        except QueryError as x:
            out.append((name, x.status))
    return e.spark.createDataFrame(out, "request string, status int")


# --- pipelines, order, expansion ---
@code("apl11_expand", "SELECT c_custkey AS Custkey, o_orderkey AS Orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def _(e: Engine) -> DataFrame:
    rows = e.query("Customers?$apply=expand(Orders,filter(Totalprice gt 400000))")
    return rows.select("Custkey", F.explode("Orders").alias("o")).select("Custkey", F.col("o.Orderkey").alias("Orderkey"))


@code("srt4_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def _(e: Engine) -> DataFrame:
    return e.spark.createDataFrame([(e.count("Orders?$filter=Totalprice gt 100000&$count=true&$top=3&$skip=2"),)], "n long")


@code("srt7_offset", "SELECT o_orderkey AS Orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24")
def _(e: Engine) -> DataFrame:
    first = e.page("Orders?$orderby=Totalprice desc&$select=Orderkey", 12)
    assert "$skip=12" in (first.next_link or "")
    return first.rows.unionByName(e.page(first.next_link or "", 12).rows)


@code("exp5_star", "SELECT n_nationkey AS Nationkey, r_name AS Region, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS C, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS S FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(e: Engine) -> DataFrame:
    rows = e.query("Nations?$expand=*")
    return rows.select("Nationkey", F.col("Region.Name").alias("Region"), F.size("Customers").cast("long").alias("C"), F.size("Suppliers").cast("long").alias("S"))


@code("exp7_derived", "SELECT p_partkey AS Partkey, CASE WHEN p_type = 'PROMO' THEN (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) ELSE 0 END AS N FROM part WHERE p_partkey < 200")
def _(e: Engine) -> DataFrame:
    rows = e.query("Goods?$filter=Partkey lt 200&$expand=Tables.Promo/Lines($select=Linenumber)&$select=Partkey")
    return rows.select("Partkey", F.size("Lines").cast("long").alias("N"))


# --- application time ---
_UPSERT = {"key": {"UserId": 1}, "start": "2023-12-01T00:00:00", "end": "2024-01-03T00:00:00", "values": {"EventType": "early"}}
_ALL = f"(SELECT event_id, event_type, a, b, TIMESTAMP '2023-12-01' AS x, TIMESTAMP '2024-01-03' AS y FROM {_STATES} WHERE user_id = 1)"


def _user(df: DataFrame) -> DataFrame:
    return df.where("UserId = 1").select("EventType", F.col("ValidFrom").alias("A"), F.col("ValidTo").alias("B"))


@code("tmp5_upsert", f"WITH s AS {_ALL}, f AS (SELECT min(a) AS first FROM s) SELECT 'early' AS EventType, x AS A, least(first, y) AS B FROM f, (SELECT DISTINCT x, y FROM s) WHERE x < first UNION ALL SELECT 'early', a, least(coalesce(b, y), y) FROM s WHERE a < y UNION ALL SELECT event_type, greatest(a, y), b FROM s WHERE b > y OR b IS NULL")
def _(e: Engine) -> DataFrame:
    s = e.model.set("UserStates")
    return _user(temporal.upsert(s.load(e.spark), s.timeline, [_UPSERT]).drop("__touched"))


@code("tmp7_several", f"WITH s AS {_ALL} SELECT event_type AS EventType, a AS A, b AS B FROM s WHERE b <= TIMESTAMP '2024-01-05' UNION ALL SELECT event_type, a, TIMESTAMP '2024-01-05' FROM s WHERE a < TIMESTAMP '2024-01-05' AND (b > TIMESTAMP '2024-01-05' OR b IS NULL) UNION ALL SELECT 'held', greatest(a, TIMESTAMP '2024-01-05'), least(coalesce(b, TIMESTAMP '2024-01-06'), TIMESTAMP '2024-01-06') FROM s WHERE a < TIMESTAMP '2024-01-06' AND (b > TIMESTAMP '2024-01-05' OR b IS NULL) UNION ALL SELECT 'kept', greatest(a, TIMESTAMP '2024-01-06'), b FROM s WHERE b > TIMESTAMP '2024-01-06' OR b IS NULL")
def _(e: Engine) -> DataFrame:
    s = e.model.set("UserStates")
    first = {"key": {"UserId": 1}, "start": "2024-01-05T00:00:00", "end": "2024-01-06T00:00:00", "values": {"EventType": "held"}}
    second = {"key": {"UserId": 1}, "start": "2024-01-06T00:00:00", "end": None, "values": {"EventType": "kept"}}
    return _user(temporal.update(s.load(e.spark), s.timeline, [first, second]).drop("__touched"))


request("tmp8_no_time", "Regions?$at=2024-01-05T00:00:00Z&$select=Regionkey", "SELECT r_regionkey AS Regionkey FROM region")


# --- changes and sync ---
def _log(e: Engine) -> DataFrame:
    return e.model.set("Events").load(e.spark).select("UserId", "Value", F.col("EventId").alias("_version"), F.col("Ts").alias("_at"), F.when(F.col("EventType") == "error", "delete").otherwise("update").alias("_op"))


@code("chg1_token_first", "SELECT (SELECT max(event_id) FROM events) AS token, (SELECT count(*) FROM events) AS n")
def _(e: Engine) -> DataFrame:
    token, rows = changes.tracked_read(_log(e), lambda: e.query("Events?$select=EventId"))
    return e.spark.createDataFrame([(token.version, rows.count())], "token long, n long")


@code("chg4_delta_pages", "SELECT user_id AS UserId, CASE WHEN max_by(event_type, event_id) = 'error' THEN 'deleted' ELSE 'updated' END AS change FROM events WHERE event_id > 100 GROUP BY 1 ORDER BY 1 LIMIT 14")
def _(e: Engine) -> DataFrame:
    found = changes.log_changes(_log(e).drop("_at"), ["UserId"], 100)
    first, after = changes.delta_page(found, ["UserId"], 7)
    second, _ = changes.delta_page(found, ["UserId"], 7, after)
    return first.unionByName(second).select("UserId", F.col("_change").alias("change"))


@code("chg4_expired", "SELECT * FROM (VALUES ('old', 410), ('new', 400)) v(token, status)")
def _(e: Engine) -> DataFrame:
    out = []
    for name, version in (("old", 3), ("new", 99)):
        try:
            changes.DeltaToken(version).check(5, 50)
        except QueryError as x:
            out.append((name, x.status))
    return e.spark.createDataFrame(out, "token string, status int")


@code("chg6_token_by_date", "SELECT user_id AS UserId, count(*) AS n FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE ts <= TIMESTAMP '2024-01-10') GROUP BY 1")
def _(e: Engine) -> DataFrame:
    token = changes.token_at(_log(e), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return _log(e).where(F.col("_version") > token.version).groupBy("UserId").agg(F.count("*").alias("n"))


def _sides(e: Engine) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("Nationkey")
    base = e.model.set("Nations").load(e.spark).select("Nationkey", "Name", F.col("Regionkey").alias("N"), F.lit(10).alias("Stamp"))
    mine = base.where(k % 7 != 0).withColumns({"Name": F.when(k % 2 == 0, F.lit("mine")).otherwise(F.col("Name")), "N": F.col("N") + 5, "Stamp": F.lit(20) + k % 3})
    theirs = base.where(k % 11 != 0).withColumns({"Name": F.when(k % 3 == 0, F.lit("theirs")).otherwise(F.col("Name")), "N": F.col("N") + 2, "Stamp": F.lit(21)})
    return base, mine, theirs


_NB = "SELECT n_nationkey AS k, n_name AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'mine' ELSE n_name END AS l, CASE WHEN n_nationkey % 3 = 0 THEN 'theirs' ELSE n_name END AS r, n_regionkey AS n, 20 + n_nationkey % 3 AS sl FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey % 11 <> 0"


@code("syn2_last_writer", f"SELECT k AS Nationkey, CASE WHEN sl > 21 THEN l ELSE r END AS Name FROM ({_NB}) UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'theirs' ELSE n_name END ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'mine' ELSE n_name END END FROM nation WHERE (n_nationkey % 7 = 0) <> (n_nationkey % 11 = 0)")
def _(e: Engine) -> DataFrame:
    base, mine, theirs = _sides(e)
    return merge.three_way(base, mine, theirs, ["Nationkey"], "last_writer", stamp="Stamp").where("_outcome <> 'deleted'").select("Nationkey", "Name")


@code("syn3_field_rules", f"SELECT k AS Nationkey, CASE WHEN l <> b THEN l ELSE r END AS Name, n + 2 AS N FROM ({_NB})")
def _(e: Engine) -> DataFrame:
    base, mine, theirs = (x.drop("Stamp") for x in _sides(e))
    merged = merge.three_way(base, mine, theirs, ["Nationkey"], "fields", "remote", field_rules={"Name": "local"})
    return merged.where("Nationkey % 7 <> 0 AND Nationkey % 11 <> 0").select("Nationkey", "Name", "N")


@code("syn7_merged_attributes", f"SELECT k AS Nationkey, n + 7 AS N FROM ({_NB})")
def _(e: Engine) -> DataFrame:
    base, mine, theirs = (x.drop("Stamp") for x in _sides(e))
    merged = merge.three_way(base, mine, theirs, ["Nationkey"], "remote", attributes={"N": merge.counter})
    return merged.where("Nationkey % 7 <> 0 AND Nationkey % 11 <> 0").select("Nationkey", "N")


@code("syn1_round", "SELECT n_nationkey AS Nationkey FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 7 <> 0 AND n_nationkey % 11 <> 0")
def _(e: Engine) -> DataFrame:
    base, mine, theirs = (x.select("Nationkey", "Name") for x in _sides(e))
    return merge.sync_round(base, mine, theirs.unionByName(base.where("Nationkey % 11 = 0")), ["Nationkey"], rule="remote")["upload"].select("Nationkey").where("Nationkey % 11 <> 0 AND Nationkey % 7 <> 0")


@code("syn5_clock", "SELECT * FROM (VALUES (1, '0000000000001000.0000.0replica'), (2, '0000000000001000.0001.0replica'), (3, '0000000000005000.0008.0replica'), (4, '0000000000006000.0000.0replica')) v(n, stamp)")
def _(e: Engine) -> DataFrame:
    clock = merge.Clock("0replica")
    out = [clock.tick(1000), clock.tick(900)]
    clock.receive("0000000000005000.0007.0000peer", 2000)
    out += [clock.tick(3000), clock.tick(6000)]
    return e.spark.createDataFrame(list(enumerate(out, 1)), "n int, stamp string")


@code("syn6_tombstones", "SELECT n_nationkey AS Nationkey, 'row' AS kind FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey, 'tombstone' FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey >= 12")
def _(e: Engine) -> DataFrame:
    rows = e.model.set("Nations").load(e.spark).select("Nationkey")
    dead = rows.where("Nationkey % 4 = 0").withColumn("deleted_at", F.col("Nationkey"))
    alive = merge.without_tombstones(rows, dead, ["Nationkey"]).withColumn("kind", F.lit("row"))
    return alive.unionByName(merge.prune_tombstones(dead, F.lit(12)).select("Nationkey", F.lit("tombstone").alias("kind")))


# --- writes ---
@code("asy1_submit", "SELECT r_regionkey AS Regionkey, r_name AS Name FROM region")
def _(e: Engine) -> DataFrame:
    job = e.submit("Regions")
    return e.spark.createDataFrame(job.result(600), e.query("Regions").schema)


@code("dml2_deep_insert", "SELECT * FROM (VALUES ('North', 26, 'A'), ('North', 25, 'B'), ('South', 27, 'C')) v(region, Nationkey, Name)")
def _(e: Engine) -> DataFrame:
    regions = e.model.set("Regions").load(e.spark)
    nations = e.model.set("Nations").load(e.spark).where("Nationkey < 25")
    new = e.spark.createDataFrame([(None, "North", 1), (None, "South", 2)], "Regionkey int, Name string, tag int")
    below = e.spark.createDataFrame([(26, "A", 1), (25, "B", 1), (27, "C", 2)], "Nationkey int, Name string, tag int")
    parents, children = writes.deep_insert(regions, nations, new, below, "Regionkey", "Nationkey", "Regionkey", "tag")
    named = parents.select("Regionkey", F.col("Name").alias("region"))
    return children.where("Nationkey >= 25").join(named, "Regionkey").select("region", "Nationkey", "Name")


@code("dml9_change_set", "SELECT n_nationkey AS Nationkey, n_name AS Name FROM nation WHERE n_nationkey <> 3")
def _(e: Engine) -> DataFrame:
    import uuid

    folder = e.spark.conf.get("spark.checkpoint.dir", None) or e.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    store = writes.Store(e.spark, f"{(folder or '/tmp/ravelin-store').rstrip('/')}/store-{uuid.uuid4().hex}")
    nations = e.model.set("Nations").load(e.spark).select("Nationkey", "Name")
    store.change_set([lambda s: s.stage("Nations", nations)])

    def broken(s: writes.Store) -> None:
        s.stage("Nations", nations.limit(0))
        writes.validate(nations, [writes.in_range("Nationkey", 5, 9)])

    try:
        store.change_set([broken])  # leaves what readers see as it was
    except QueryError:
        pass
    store.change_set([lambda s: s.stage("Nations", writes.delete(s.read("Nations"), F.col("Nationkey") == 3))])
    return store.read("Nations")


@code("dml10_etag", "SELECT n_nationkey AS Nationkey, 'W/\"' || left(sha256('{\"Nationkey\":' || n_nationkey || '}' || chr(10) || '{\"Name\":\"' || n_name || '\"}'), 16) || '\"' AS etag FROM nation")
def _(e: Engine) -> DataFrame:
    return e.model.set("Nations").load(e.spark).select("Nationkey", writes.etag(["Nationkey", "Name"]).alias("etag"))


@code("dml11_validation", "SELECT (SELECT count(*) FROM part WHERE p_size % 2 <> 0) AS odd, (SELECT count(*) FROM part WHERE p_size > 40) AS large, (SELECT count(*) FROM part WHERE NOT regexp_matches(p_brand, '^Brand#1[0-9]$')) AS brand")
def _(e: Engine) -> DataFrame:
    import re

    rules = [writes.multiple_of("Size", 2), writes.in_range("Size", 0, 40), writes.matching("Brand", "^Brand#1[0-9]$")]
    try:
        writes.validate(e.model.set("Parts").load(e.spark), rules)
        told: list[str] = []
    except QueryError as x:
        told = str(x).split("; ")

    def broken(stem: str) -> int:
        return next((int(re.search(r"\((\d+) rows\)", t)[1]) for t in told if stem in t), 0)  # type: ignore[index]

    return e.spark.createDataFrame([(broken("multiple of"), broken("within"), broken("match"))], "odd long, large long, brand long")


@code("dml11_model_terms", "SELECT (SELECT count(*) FROM part WHERE p_size < 5) AS low, (SELECT count(*) FROM part WHERE p_size >= 45) AS high, (SELECT count(*) FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')) AS type, (SELECT count(*) FROM part WHERE length(p_name) > 9) AS name")
def _(e: Engine) -> DataFrame:
    import re

    s = e.model.set("Parts")
    s.validation = {"Size": {"Minimum": 5, "Maximum": 45, "MaximumExclusive": True}, "Type": {"AllowedValues": ("PROMO", "SMALL")}, "Name": {"MaxLength": 9, "Required": True}}
    try:
        writes.validate(s.load(e.spark), writes.rules_of(s))
        told = ""
    except QueryError as x:
        told = str(x)
    counts = [int(m[1]) if (m := re.search(stem + r"[^;]*\((\d+) rows\)", told)) else 0 for stem in ("Size must be above", "Size must be below", "Type must be one", "Name must have at most")]
    return e.spark.createDataFrame([tuple(counts)], "low long, high long, type long, name long")


# --- functions and the builder ---
request("udf1_overload_none", "Goods/Tables.Picked()?$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_partkey <= 3")
request("udf1_overload_one", "Goods/Tables.Picked(upto=9)?$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_partkey <= 9")
request("udf1_overload_two", "Goods/Tables.Picked(upto=90,least=20.5)?$select=Partkey", f"SELECT k AS Partkey FROM {GOODS} WHERE k <= 90 AND size >= 20.5")
refused("udf1_refused", **{"Goods/Tables.Picked(most=3)": 400, "Goods/Tables.Picked(upto='x')": 400})


@code("udf4_handlers", "SELECT n_regionkey AS Regionkey, count(*) AS N FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1")
def _(e: Engine) -> DataFrame:
    nations = e.model.set("Nations")
    load = nations.load
    nations.load = lambda spark: load(spark).withColumn("Name", F.upper("Name"))
    nations.visible = lambda df: F.col("Nationkey") % 2 == 0
    return e.query("Nations?$apply=groupby((Regionkey),aggregate($count as N))")


request("cli2_fetch", Query("Orders").filter(field("Orderstatus") == "F").orderby("Totalprice desc").skip(3).top(5).select("Orderkey", "Totalprice").url, "SELECT o_orderkey AS Orderkey, o_totalprice AS Totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 3")
request("cli5_version", "Parts?$filter=" + ((field("Size").isin(1, 2, 3)) & (field("Type") == "PROMO")).text("4.0") + "&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_size IN (1, 2, 3) AND p_type = 'PROMO'")
_TEXT = "not (Size gt 20 and (Size add 3) mul 2 lt 80) or Size sub (3 sub 1) eq 4"
request("cli6_round_trip", f"Parts?$filter={parse_expression(str(parse_expression(_TEXT)))}&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE NOT (p_size > 20 AND (p_size + 3) * 2 < 80) OR p_size - (3 - 1) = 4")
request("str9_like", "Parts?$filter=matchesPattern(Name,'^c.ld.*$')&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_name LIKE 'c_ld%'")
