"""The registered queries: a request (or a few lines of code) and independent SQL for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.builder import Query, field
from ravelin.engine import Engine
from ravelin.operators import changes, merge, temporal, writes
from ravelin.operators.frame import c
from ravelin.sources import csdl
from ravelin.sources.catalog import table_model

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    model = table_model(sf_dir)
    model.methods["Tables.range"] = lambda x: F.max(x) - F.min(x)
    model.aggregates["Revenue"] = lambda: F.sum(c("Extendedprice") * (1 - c("Discount")))
    model.functions["Tables.Cheapest"] = lambda e, frame, n=3: frame.with_df(frame.df.orderBy("Retailprice", "Partkey").limit(int(n)))
    model.functions["Tables.twice"] = lambda x: x * 2
    return Engine(spark, model, now="1998-01-01T00:00:00Z")


def shaped(df: DataFrame, names: str | None, rounds: str = "") -> DataFrame:
    """Renames by position and rounds money to cents, so that engines compare."""
    if names:
        df = df.toDF(*names.split())
    for n in rounds.split():
        name, _, digits = n.partition(":")
        df = df.withColumn(name, F.round(c(name).cast("double"), int(digits or 2)))
    return df


def request(name: str, url: str, sql: str, names: str | None = None, rounds: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: shaped(engine(spark, sf_dir).query(url), names, rounds)
    SQL[name] = sql


def code(name: str, sql: str | None) -> Callable[[Callable[[Engine], DataFrame]], None]:
    def register(f: Callable[[Engine], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: f(engine(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql

    return register


# --- scans and paths ---
request("src1_scan", "Nations", "SELECT n_nationkey AS Nationkey, n_name AS Name, n_regionkey AS Regionkey FROM nation")
request("src2_key", "Customers(7)?$select=Custkey,Name,Acctbal", "SELECT c_custkey AS Custkey, c_name AS Name, c_acctbal AS Acctbal FROM customer WHERE c_custkey = 7")
request("src2_compound_key", "Conversations(ConvId=1,Turn=0)?$select=ConvId,Turn,Role", 'SELECT conv_id AS "ConvId", turn AS "Turn", role AS "Role" FROM conversations WHERE conv_id = 1 AND turn = 0')
request("src3_key_segment", "Customers/7?$select=Custkey,Name", "SELECT c_custkey AS Custkey, c_name AS Name FROM customer WHERE c_custkey = 7")
request("src4_navigation", "Customers(5)/Orders?$select=Orderkey,Totalprice", "SELECT o_orderkey AS Orderkey, o_totalprice AS Totalprice FROM orders WHERE o_custkey = 5")
request("src4_navigation_to_one", "Orders(3)/Customer/Nation?$select=Name", "SELECT n_name AS Name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 3")
request("src4_navigation_bridge", "Suppliers(1)/Parts?$select=Partkey,Brand", "SELECT p_partkey AS Partkey, p_brand AS Brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1)")
request("src6_filter_segment", "Orders/$filter(Orderstatus eq 'F')/$filter(Totalprice gt 400000)?$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
request("src7_property", "Customers(7)/Name/$value", "SELECT c_name AS value FROM customer WHERE c_custkey = 7")
request("src8_references", "Customers(5)/Orders/$ref", "SELECT 'Orders(' || o_orderkey || ')' AS id FROM orders WHERE o_custkey = 5")
request("src9_count", "Customers/$count?$filter=Acctbal lt 0", "SELECT count(*) AS count FROM customer WHERE c_acctbal < 0")
request("src9_count_apply", "Orders/$count?$apply=filter(Orderstatus eq 'O')", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O'")
request("src10_none", "Regions?$filter=false", "SELECT r_regionkey AS Regionkey, r_name AS Name FROM region WHERE false")

# --- projections and predicates ---
request("prj1_select", "Suppliers?$select=Suppkey,Acctbal", "SELECT s_suppkey AS Suppkey, s_acctbal AS Acctbal FROM supplier")
request("prj2_compute", "Lineitems?$compute=Extendedprice mul (1 sub Discount) as Net&$filter=Net gt 50000&$select=Orderkey,Linenumber,Net", "SELECT l_orderkey AS Orderkey, l_linenumber AS Linenumber, round(l_extendedprice * (1 - l_discount), 4) AS Net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000", rounds="Net:4")
request("prj2_compute_chain", "Parts?$compute=Size mul 2 as Twice,Twice add 1 as More&$filter=More gt 60&$select=Partkey,More", "SELECT p_partkey AS Partkey, p_size * 2 + 1 AS More FROM part WHERE p_size * 2 + 1 > 60")
request("prj3_filter", "Orders?$filter=Totalprice gt 100000 and Orderstatus ne 'F'&$select=Orderkey,Totalprice", "SELECT o_orderkey AS Orderkey, o_totalprice AS Totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
for _op, _sql in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    request(f"prj4_{_op}", f"Parts?$filter=Size {_op} 25&$select=Partkey", f"SELECT p_partkey AS Partkey FROM part WHERE p_size {_sql} 25")
request("prj4_swapped", "Parts?$filter=25 lt Size&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_size > 25")
request("prj5_fraction", "Parts?$filter=Size lt 2.5 or Size eq 7.5&$select=Partkey,Size", "SELECT p_partkey AS Partkey, p_size AS Size FROM part WHERE p_size <= 2")
request("prj5_nan", "Customers?$filter=Acctbal ne NaN and not (Acctbal lt NaN) and Acctbal lt INF&$select=Custkey", "SELECT c_custkey AS Custkey FROM customer")
request("prj6_kleene", "Orders?$filter=not (Orderstatus eq 'F' or Totalprice gt 200000) and not not (Custkey gt 10)&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_custkey > 10")
request("prj7_in", "Customers?$filter=Mktsegment in ('BUILDING','FURNITURE')&$select=Custkey", "SELECT c_custkey AS Custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
request("prj7_not_in", "Parts?$filter=not (Size in (1,2,3.5,null))&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_size NOT IN (1, 2)")
request("prj8_has", "Parts?$filter=Size has 5&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE (p_size & 5) = 5")
request("prj9_arithmetic", "Parts?$compute=Size add 3 as A,Size sub 3 as B,Size mul 3 as C,Size div 3 as D,Size divby 4 as E,Size mod 4 as G,-Size as H&$select=Partkey,A,B,C,D,E,G,H", "SELECT p_partkey AS Partkey, p_size + 3 AS A, p_size - 3 AS B, p_size * 3 AS C, CAST(p_size // 3 AS BIGINT) AS D, p_size / 4.0::DOUBLE AS E, p_size % 4 AS G, -p_size AS H FROM part")
request("prj9_divide_by_zero", "Parts?$compute=Size div (Size sub Size) as Z&$filter=Z eq null&$select=Partkey", "SELECT p_partkey AS Partkey FROM part")
request("prj10_path", "Customers?$filter=Nation/Region/Name eq 'ASIA'&$select=Custkey", "SELECT c_custkey AS Custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
request("prj12_alias", "Orders?$filter=Totalprice gt @p and Orderstatus eq @s&@p=300000&@s=@t&@t='O'&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
request("prj13_it", "Customers?$filter=Orders/any(o:o/Totalprice gt $it/Acctbal mul 45)&$select=Custkey", "SELECT c_custkey AS Custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 45)")
request("prj15_any", "Orders?$filter=Items/any(i:i/Quantity gt 45)&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
request("prj15_all", "Orders?$filter=Items/all(i:i/Discount lt 0.05)&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT l_discount < 0.05)")
request("prj15_none", "Orders?$filter=not Items/any()&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
request("prj15_or", "Orders?$filter=Items/any(i:i/Quantity gt 49) or Totalprice lt 5000&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_totalprice < 5000 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
request("prj15_nested", "Customers?$filter=Orders/any(o:o/Orderstatus eq 'F' and o/Items/any(i:i/Quantity gt 48))&$select=Custkey", "SELECT DISTINCT o_custkey AS Custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 48")
request("prj15_through_to_one", "Orders?$filter=Customer/Orders/any(o:o/Totalprice gt 490000)&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)")
request("prj16_count", "Customers?$filter=Orders/$count gt 12&$select=Custkey", "SELECT o_custkey AS Custkey FROM orders GROUP BY 1 HAVING count(*) > 12")
request("prj17_filtered_count", "Customers?$filter=Orders/$count($filter=Orderstatus eq 'O') ge 5&$select=Custkey", "SELECT o_custkey AS Custkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) >= 5")
request("prj18_navigation_aggregate", "Customers?$filter=Orders/aggregate(Totalprice with max) gt 400000&$compute=Orders/aggregate(Totalprice with average) as Mean,Orders/aggregate(Totalprice with min) as Low&$select=Custkey,Mean,Low", "SELECT o_custkey AS Custkey, round(avg(o_totalprice), 6) AS Mean, round(min(o_totalprice), 2) AS Low FROM orders GROUP BY 1 HAVING max(o_totalprice) > 400000", rounds="Mean:6 Low")
request("prj19_these", "Parts?$filter=Retailprice gt $these/aggregate(Retailprice with average)&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
request("prj19_these_count", "Regions?$compute=$these/$count as N&$select=Regionkey,N", "SELECT r_regionkey AS Regionkey, (SELECT count(*) FROM region) AS N FROM region")
request("prj22_cast", "Parts?$compute=cast(Size,Edm.Int64) as Wide&$select=Partkey,Wide", "SELECT p_partkey AS Partkey, CAST(p_size AS BIGINT) AS Wide FROM part")
request("prj20_isof", "Parts?$filter=isof(Size,Edm.Int64) and isof(Tables.Part)&$select=Partkey", "SELECT p_partkey AS Partkey FROM part")
request("prj23_isdefined", "Parts?$filter=isdefined(Size) and not isdefined(Nothing)&$select=Partkey", "SELECT p_partkey AS Partkey FROM part")
request("prj24_dynamic", "Events?$filter=k eq '7'&$select=EventId", "SELECT event_id AS \"EventId\" FROM events WHERE json_extract_string(props, '$.k') = '7'")
request("prj25_navigation_null", "Documents?$filter=Label eq null&$select=DocId", 'SELECT doc_id AS "DocId" FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)')
request("prj26_search", 'Parts?$search=(widget OR BOLT) NOT "cold widget"&$select=Partkey', "SELECT p_partkey AS Partkey FROM part WHERE (contains(lower(p_name || ' | ' || p_brand || ' | ' || p_type), 'widget') OR contains(lower(p_name || ' | ' || p_brand || ' | ' || p_type), 'bolt')) AND NOT contains(lower(p_name || ' | ' || p_brand || ' | ' || p_type), 'cold widget')")
request("prj27_function", "Parts?$compute=Tables.twice(Size) as Twice&$select=Partkey,Twice", "SELECT p_partkey AS Partkey, p_size * 2 AS Twice FROM part")

# --- scalar functions ---
_FUNCTIONS = {
    "str1_contains": ("contains(Name,'cold')", "contains(p_name, 'cold')"), "str1_startswith": ("startswith(Name,'large')", "starts_with(p_name, 'large')"), "str1_endswith": ("endswith(Name,'bolt')", "ends_with(p_name, 'bolt')"),
    "str2_case": ("tolower(Type) eq 'promo' and toupper(Name) ne Name", "lower(p_type) = 'promo' AND upper(p_name) <> p_name"), "str3_length": ("length(Name) gt 11", "length(p_name) > 11"),
    "str4_substring": ("substring(Brand,5) eq '#11' or substring(Brand,0,2) eq 'xx'", "substr(p_brand, 6) = '#11' OR substr(p_brand, 1, 2) = 'xx'"), "str5_indexof": ("indexof(Name,'e') eq 3", "instr(p_name, 'e') - 1 = 3"),
    "str6_trim": ("trim(concat('  ',Name)) eq Name", "trim('  ' || p_name) = p_name"), "str7_concat": ("concat(concat(Type,'-'),Brand) eq 'PROMO-Brand#11'", "p_type || '-' || p_brand = 'PROMO-Brand#11'"),
    "str8_pattern": ("matchesPattern(Name,'^(cold|hot).*t$')", "regexp_matches(p_name, '^(cold|hot).*t$')"), "mth1_floor": ("floor(Retailprice) eq 910 or ceiling(Retailprice) eq 905", "floor(p_retailprice) = 910 OR ceil(p_retailprice) = 905"),
    "mth2_round": ("round(Retailprice) eq 910", "round(p_retailprice) = 910"),
}
for _name, (_condition, _sql) in _FUNCTIONS.items():
    request(_name, f"Parts?$filter={_condition}&$select=Partkey", f"SELECT p_partkey AS Partkey FROM part WHERE {_sql}")
request("dat1_parts", "Events?$compute=year(Ts) as Y,month(Ts) as M,day(Ts) as D,hour(Ts) as H,minute(Ts) as N,second(Ts) as S&$select=EventId,Y,M,D,H,N,S", 'SELECT event_id AS "EventId", CAST(year(ts) AS INT) AS Y, CAST(month(ts) AS INT) AS M, CAST(day(ts) AS INT) AS D, CAST(hour(ts) AS INT) AS H, CAST(minute(ts) AS INT) AS N, CAST(second(ts) AS INT) AS S FROM events')
request("dat1_year", "Orders?$filter=year(Orderdate) eq 1997 and month(Orderdate) ge 11&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) >= 11")
request("dat2_date", "Events?$compute=date(Ts) as Day&$filter=Day eq 2024-01-05&$select=EventId,Day", "SELECT event_id AS \"EventId\", CAST(ts AS DATE) AS Day FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
request("dat3_now", "Orders?$filter=Orderdate lt now()&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'")
request("dat_range", "Orders?$filter=Orderdate ge 1997-01-01 and Orderdate lt 1997-02-01T00:00:00Z&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1997-02-01'")
request("arr1_any", "Embeddings?$filter=Embedding/any(x:x gt 0.4)&$select=VecId", 'SELECT vec_id AS "VecId" FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.4)) > 0')
request("arr1_all", "Embeddings?$filter=Embedding/all(x:x lt 0.3)&$select=VecId", 'SELECT vec_id AS "VecId" FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT x < 0.3)) = 0')

# --- joins ---
_J = "FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
request("jon1_to_one", "Orders?$select=Orderkey,Customer/Name&$filter=Customer/Acctbal lt 0", "SELECT o_orderkey AS Orderkey, c_name AS CustomerName FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0", "Orderkey CustomerName")
request("jon2_semi", "Customers?$filter=Orders/any(o:o/Orderpriority eq '1-URGENT')&$select=Custkey", "SELECT c_custkey AS Custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
request("jon3_join", "Orders?$apply=join(Items as I)/groupby((I/Returnflag),aggregate(I/Quantity with sum as Q))", f"SELECT l_returnflag AS Flag, sum(l_quantity) AS Q {_J} GROUP BY 1", "Flag Q")
request("jon4_outerjoin", "Orders?$apply=outerjoin(Items as I)/groupby((I/Returnflag),aggregate($count as N))", "SELECT l_returnflag AS Flag, count(*) AS N FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", "Flag N")
request("jon5_sequence", "Orders?$apply=join(Items as I,filter(Quantity gt 40))/groupby((I/Returnflag),aggregate(I/Quantity with sum as Q,$count as N))", f"SELECT l_returnflag AS Flag, sum(l_quantity) AS Q, count(*) AS N {_J} WHERE l_quantity > 40 GROUP BY 1", "Flag Q N")
request("jon5_top_per_parent", "Customers?$apply=join(Orders as O,topcount(1,Totalprice))/aggregate(O/Totalprice with sum as T,$count as N)", "SELECT round(sum(m), 2) AS T, count(*) AS N FROM (SELECT max(o_totalprice) AS m FROM orders GROUP BY o_custkey)", rounds="T")
request("jon7_bridge", "Parts?$filter=Suppliers/any(s:s/Acctbal lt 0)&$select=Partkey", "SELECT DISTINCT l_partkey AS Partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0")

# --- aggregation ---
request("agg1_aggregate", "Lineitems?$apply=aggregate(Quantity with sum as Q,Extendedprice with average as P,$count as N)", "SELECT sum(l_quantity) AS Q, round(avg(l_extendedprice), 6) AS P, count(*) AS N FROM lineitem", rounds="P:6")
request("agg1_empty", "Lineitems?$apply=filter(Quantity lt 0)/aggregate(Quantity with sum as Q,$count as N)", "SELECT sum(l_quantity) AS Q, count(*) AS N FROM lineitem WHERE l_quantity < 0")
request("agg2_keys", "Orders?$apply=groupby((Orderstatus,Customer/Mktsegment))", "SELECT DISTINCT o_orderstatus AS Status, c_mktsegment AS Segment FROM orders JOIN customer ON c_custkey = o_custkey", "Status Segment")
request("agg3_flagship", "Lineitems?$apply=filter(Shipdate le 1998-09-02)/groupby((Returnflag,Linestatus),aggregate(Quantity with sum as SumQty,Extendedprice with sum as SumBase,Extendedprice mul (1 sub Discount) with sum as SumDisc,Quantity with average as AvgQty,$count as N))", "SELECT l_returnflag AS Returnflag, l_linestatus AS Linestatus, sum(l_quantity) AS SumQty, round(sum(l_extendedprice), 2) AS SumBase, round(sum(l_extendedprice * (1 - l_discount)), 4) AS SumDisc, round(avg(l_quantity), 6) AS AvgQty, count(*) AS N FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2", rounds="SumBase SumDisc:4 AvgQty:6")
request("agg4_sequence", "Customers?$apply=groupby((Mktsegment),topcount(2,Acctbal)/aggregate(Acctbal with sum as T))", "SELECT c_mktsegment AS Mktsegment, round(sum(c_acctbal), 2) AS T FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 2 GROUP BY 1", rounds="T")
request("agg4_nested_groups", "Customers?$apply=groupby((Mktsegment),filter(Acctbal gt $these/aggregate(Acctbal with average))/groupby((Nation/Name),aggregate($count as N)))", "SELECT c_mktsegment AS Segment, n_name AS Nation, count(*) AS N FROM (SELECT *, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS a FROM customer) JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > a GROUP BY 1, 2", "Segment Nation N")
request("agg5_count", "Events?$apply=groupby((EventType),aggregate($count as N))", 'SELECT event_type AS "EventType", count(*) AS N FROM events GROUP BY 1')
request("agg6_navigation_count", "Customers?$apply=groupby((Mktsegment),aggregate(Orders/$count as N))", "SELECT c_mktsegment AS Mktsegment, CAST(count(*) AS BIGINT) AS N FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
request("agg9_min_max", "Orders?$apply=groupby((Orderstatus),aggregate(Orderdate with min as First,Orderdate with max as Last,Orderpriority with max as P))", "SELECT o_orderstatus AS Orderstatus, min(o_orderdate) AS First, max(o_orderdate) AS Last, max(o_orderpriority) AS P FROM orders GROUP BY 1")
request("agg10_distinct", "Lineitems?$apply=groupby((Returnflag),aggregate(Partkey with countdistinct as N))", "SELECT l_returnflag AS Returnflag, count(DISTINCT l_partkey) AS N FROM lineitem GROUP BY 1")
request("agg11_expression", "Lineitems?$apply=groupby((Linestatus),aggregate(Extendedprice mul Discount with sum as D))", "SELECT l_linestatus AS Linestatus, round(sum(l_extendedprice * l_discount), 4) AS D FROM lineitem GROUP BY 1", rounds="D:4")
request("agg12_to_many", "Customers?$apply=groupby((Nation/Name),aggregate(Orders/Totalprice with sum as S,Orders/Totalprice with average as A,Orders/Totalprice with max as M))", "SELECT n_name AS Nation, round(sum(o_totalprice), 2) AS S, round(avg(o_totalprice), 6) AS A, round(max(o_totalprice), 2) AS M FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1", "Nation S A M", "S A:6 M")
request("agg13_custom_method", "Parts?$apply=groupby((Type),aggregate(Size with Tables.range as R))", "SELECT p_type AS Type, max(p_size) - min(p_size) AS R FROM part GROUP BY 1")
request("agg14_custom_aggregate", "Lineitems?$apply=groupby((Returnflag),aggregate(Revenue))", "SELECT l_returnflag AS Returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS Revenue FROM lineitem GROUP BY 1", rounds="Revenue:4")
request("agg15_regroup", "Customers?$apply=groupby((Nation/Name,Mktsegment),aggregate($count as N))/groupby((Mktsegment),aggregate(N with max as M,$count as K))", "SELECT c_mktsegment AS Mktsegment, max(N) AS M, count(*) AS K FROM (SELECT c_mktsegment, c_nationkey, count(*) AS N FROM customer GROUP BY 1, 2) GROUP BY 1")
request("agg16_computed_key", "Orders?$apply=compute(year(Orderdate) as Y)/groupby((Y),aggregate($count as N))", "SELECT CAST(year(o_orderdate) AS INT) AS Y, count(*) AS N FROM orders GROUP BY 1")
request("agg20_having", Query("Orders").group(["Custkey"], having="N gt 15", N="$count").url, "SELECT o_custkey AS Custkey, count(*) AS N FROM orders GROUP BY 1 HAVING count(*) > 15")

# --- other transformations ---
request("apl1_identity", "Regions?$apply=identity", "SELECT r_regionkey AS Regionkey, r_name AS Name FROM region")
request("apl2_filter_groups", "Orders?$apply=groupby((Custkey),aggregate(Totalprice with sum as T))/filter(T gt 3000000 and isdefined(T))", "SELECT o_custkey AS Custkey, round(sum(o_totalprice), 2) AS T FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 3000000", rounds="T")
request("apl3_search", "Parts?$apply=search(widget)/aggregate($count as N)", "SELECT count(*) AS N FROM part WHERE contains(lower(p_name), 'widget')")
request("apl4_compute_groups", "Customers?$apply=groupby((Mktsegment),aggregate($count as N,Acctbal with sum as T))/compute(T divby N as Mean)", "SELECT c_mktsegment AS Mktsegment, count(*) AS N, round(sum(c_acctbal), 2) AS T, round(sum(c_acctbal) / count(*), 6) AS Mean FROM customer GROUP BY 1", rounds="T Mean:6")
request("apl5_orderby_top", "Customers?$apply=orderby(Acctbal desc)/skip(2)/top(5)&$select=Custkey,Acctbal", "SELECT c_custkey AS Custkey, c_acctbal AS Acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 2")
for _kind, _sort in (("top", "DESC"), ("bottom", "ASC")):
    _run = f"SELECT *, sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER (ORDER BY c_acctbal {_sort}, c_custkey ROWS UNBOUNDED PRECEDING) - CAST(c_acctbal AS DECIMAL(18,2)) AS b, sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER () AS t FROM customer"
    _high = f"SELECT *, max(b) OVER (ORDER BY c_acctbal {_sort}, c_custkey ROWS UNBOUNDED PRECEDING) AS h FROM ({_run})"
    request(f"apl7_{_kind}count", f"Customers?$apply={_kind}count(10,Acctbal)&$select=Custkey", f"SELECT c_custkey AS Custkey FROM customer ORDER BY c_acctbal {_sort}, c_custkey LIMIT 10")
    request(f"apl8_{_kind}sum", f"Customers?$apply={_kind}sum(50000.5,Acctbal)&$select=Custkey", f"SELECT c_custkey AS Custkey FROM ({_high}) WHERE h < 50000.5")
    request(f"apl9_{_kind}percent", f"Customers?$apply={_kind}percent(5.1,Acctbal)&$select=Custkey", f"SELECT c_custkey AS Custkey FROM ({_high}) WHERE h < t * 5.1 / 100")
request("apl7_topcount_expression", "Customers?$apply=topcount($these/$count div 10,Acctbal)&$select=Custkey", "SELECT c_custkey AS Custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER () AS n FROM customer) WHERE k <= n // 10")
request("apl10_concat", "Customers?$apply=concat(groupby((Mktsegment),aggregate(Acctbal with sum as T)),aggregate(Acctbal with sum as T))", "SELECT c_mktsegment AS Mktsegment, round(sum(c_acctbal), 2) AS T FROM customer GROUP BY 1 UNION ALL SELECT NULL, round(sum(c_acctbal), 2) FROM customer", rounds="T")
request("apl14_options_after", "Orders?$apply=groupby((Custkey),aggregate(Totalprice with sum as T))&$filter=T gt 1000000&$orderby=T desc,Custkey&$top=5&$select=Custkey", "SELECT o_custkey AS Custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 5")

# --- order and paging ---
request("srt1_orderby", "Orders?$orderby=Orderstatus,Totalprice desc&$top=7&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 7")
request("srt1_expression", "Customers?$orderby=Orders/$count desc,length(Name)&$top=5&$select=Custkey", "SELECT c_custkey AS Custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY coalesce(n, 0) DESC, length(c_name), c_custkey LIMIT 5")
request("srt2_flagship", "Orders?$filter=Totalprice gt 100000 and Customer/Mktsegment eq 'BUILDING'&$orderby=Totalprice desc&$top=10&$select=Orderkey,Totalprice", "SELECT o_orderkey AS Orderkey, o_totalprice AS Totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000 AND c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
request("srt3_skip_top", "Parts?$orderby=Size desc&$skip=20&$top=10&$select=Partkey", "SELECT p_partkey AS Partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 10 OFFSET 20")
request("srt3_top_zero", "Parts?$top=0&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE false")
request("srt6_keyset", "Orders?$skiptoken=100&$top=5&$select=Orderkey", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 5")
request("srt6_keyset_compound", "Conversations?$skiptoken=3,1&$top=5&$select=ConvId,Turn", 'SELECT conv_id AS "ConvId", turn AS "Turn" FROM conversations WHERE conv_id > 3 OR (conv_id = 3 AND turn > 1) ORDER BY 1, 2 LIMIT 5')

# --- hierarchies ---
_TREE = "WITH RECURSIVE t(node, parent) AS (SELECT p_partkey, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END FROM part)"
_DOWN = f"{_TREE}, d(node, k) AS (SELECT CAST(5 AS BIGINT), 0 UNION ALL SELECT t.node, k + 1 FROM t JOIN d ON t.parent = d.node)"
_UP = f"{_TREE}, u(node, k) AS (SELECT node, 0 FROM t WHERE node = 77 UNION ALL SELECT t.parent, k + 1 FROM t JOIN u ON t.node = u.node WHERE t.parent IS NOT NULL)"
_H = "HierarchyNodes=$root/Parts,HierarchyQualifier='PartTree',Node=Partkey"
request("hie2_isroot", f"Parts?$filter=Tables.isroot({_H})&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_partkey <= 1")
request("hie2_isleaf", f"Parts?$filter=Tables.isleaf({_H})&$select=Partkey", f"{_TREE} SELECT node AS Partkey FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)")
request("hie2_isnode", f"Lineitems?$filter=Tables.isnode({_H}) and Quantity gt 49&$select=Orderkey,Linenumber", "SELECT l_orderkey AS Orderkey, l_linenumber AS Linenumber FROM lineitem WHERE l_quantity > 49")
request("hie3_isdescendant", f"Parts?$filter=Tables.isdescendant({_H},Ancestor=5,MaxDistance=3)&$select=Partkey", f"{_DOWN} SELECT node AS Partkey FROM d WHERE k BETWEEN 1 AND 3")
request("hie3_isancestor", f"Parts?$filter=Tables.isancestor({_H},Descendant=77,IncludeSelf=true)&$select=Partkey", f"{_UP} SELECT node AS Partkey FROM u")
request("hie4_issibling", f"Parts?$filter=Tables.issibling({_H},Other=21)&$select=Partkey", "SELECT p_partkey AS Partkey FROM part WHERE p_partkey = 20")
request("hie5_descendants", "Parts?$apply=descendants($root/Parts,PartTree,Partkey,filter(Partkey eq 5),4,keep start)&$select=Partkey", f"{_DOWN} SELECT node AS Partkey FROM d WHERE k <= 4")
request("hie5_ancestors", "Parts?$apply=ancestors($root/Parts,PartTree,Partkey,Partkey eq 77)&$select=Partkey", f"{_UP} SELECT node AS Partkey FROM u WHERE k > 0")
_PATH = f"{_TREE}, s AS (SELECT node, parent, row_number() OVER (PARTITION BY parent ORDER BY p_name DESC, node) AS r FROM t JOIN part ON p_partkey = node), w(node, path) AS (SELECT node, [r] FROM s WHERE parent IS NULL UNION ALL SELECT s.node, list_append(w.path, s.r) FROM s JOIN w ON s.parent = w.node)"
request("hie6_preorder", "Parts?$apply=traverse($root/Parts,PartTree,Partkey,preorder,Name desc)&$top=25&$select=Partkey", f"{_PATH} SELECT node AS Partkey FROM w ORDER BY path LIMIT 25")
request("hie6_postorder", "Parts?$apply=traverse($root/Parts,PartTree,Partkey,postorder,Name desc)&$top=25&$select=Partkey", f"{_PATH} SELECT node AS Partkey FROM w ORDER BY list_append(path, 1000000000) LIMIT 25")


# --- expansion: flattened to compare ---
@code("exp1_to_one", "SELECT o_orderkey AS Orderkey, c_name AS Name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 450000")
def _(e: Engine) -> DataFrame:
    return e.query("Orders?$filter=Totalprice gt 450000&$expand=Customer($select=Name)&$select=Orderkey").select("Orderkey", "Customer.Name")


@code("exp2_to_many", "SELECT c_custkey AS Custkey, count(o_orderkey) AS N, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS S FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(e: Engine) -> DataFrame:
    rows = e.query("Customers?$expand=Orders($select=Orderkey)&$select=Custkey")
    return rows.select("Custkey", F.size("Orders").cast("long").alias("N"), F.aggregate("Orders.Orderkey", F.lit(0).cast("long"), lambda a, x: a + x).alias("S"))


@code("exp3_options", "SELECT o_custkey AS Custkey, o_orderkey AS Orderkey, n AS N, k - 1 AS Place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE k BETWEEN 2 AND 3")
def _(e: Engine) -> DataFrame:
    rows = e.query("Customers?$expand=Orders($filter=Orderstatus eq 'O';$orderby=Totalprice desc;$skip=1;$top=2;$count=true;$select=Orderkey)&$select=Custkey")
    flat = rows.select("Custkey", c("Orders@count").alias("N"), F.posexplode("Orders").alias("p", "o"))
    return flat.select("Custkey", c("o.Orderkey".split(".")[0]).getField("Orderkey").alias("Orderkey"), "N", (F.col("p") + 1).cast("long").alias("Place"))


@code("exp4_count", "SELECT c_custkey AS Custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS N FROM customer")
def _(e: Engine) -> DataFrame:
    return e.query("Customers?$expand=Orders/$count&$select=Custkey").select("Custkey", c("Orders@count").alias("N"))


@code("exp6_levels", "SELECT a.p_partkey AS A, b.p_partkey AS B, d.p_partkey AS C FROM part a JOIN part b ON b.p_partkey // 2 = a.p_partkey AND b.p_partkey > 1 JOIN part d ON d.p_partkey // 2 = b.p_partkey AND d.p_partkey > 1 WHERE a.p_partkey BETWEEN 1 AND 20")
def _(e: Engine) -> DataFrame:
    rows = e.query("Parts?$filter=Partkey ge 1 and Partkey le 20&$expand=SubParts($levels=2)&$select=Partkey")
    two = rows.select(F.col("Partkey").alias("A"), F.explode("SubParts").alias("s"))
    return two.select("A", F.col("s.Partkey").alias("B"), F.explode("s.SubParts").alias("t")).select("A", "B", F.col("t.Partkey").alias("C"))


@code("exp8_filtered_to_one", "SELECT o_orderkey AS Orderkey, c_custkey AS Custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_totalprice > 450000")
def _(e: Engine) -> DataFrame:
    rows = e.query("Orders?$filter=Totalprice gt 450000&$expand=Customer($filter=Acctbal gt 0)&$select=Orderkey")
    return rows.select("Orderkey", F.col("Customer.Custkey").alias("Custkey"))


# --- application time ---
_STATES = "(SELECT event_id, user_id, event_type, value, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"
request("tmp1_at", "UserStates?$at=2024-01-05T00:00:00Z&$select=EventId,UserId", f"SELECT event_id AS \"EventId\", user_id AS \"UserId\" FROM {_STATES} WHERE a <= TIMESTAMP '2024-01-05' AND (b > TIMESTAMP '2024-01-05' OR b IS NULL)")
request("tmp2_period", "UserStates?$from=2024-01-05&$to=2024-01-06&$select=EventId", f"SELECT event_id AS \"EventId\" FROM {_STATES} WHERE a < TIMESTAMP '2024-01-06' AND (b > TIMESTAMP '2024-01-05' OR b IS NULL)")
request("tmp2_inclusive", "UserStates?$from=2024-01-05&$toInclusive=2024-01-06&$select=EventId", f"SELECT event_id AS \"EventId\" FROM {_STATES} WHERE a <= TIMESTAMP '2024-01-06' AND (b > TIMESTAMP '2024-01-05' OR b IS NULL)")
_DELTA = {"key": {"UserId": 1}, "start": "2024-01-05T00:00:00", "end": "2024-01-08T00:00:00", "values": {"EventType": "held"}}
_CUT = "TIMESTAMP '2024-01-05' AS x, TIMESTAMP '2024-01-08' AS y"
_HIT = f"h AS (SELECT *, {_CUT} FROM {_STATES} WHERE user_id = 1 AND a < TIMESTAMP '2024-01-08' AND (b > TIMESTAMP '2024-01-05' OR b IS NULL))"
_OUTSIDE = "SELECT event_id, event_type, a, x AS b FROM h WHERE a < x UNION ALL SELECT event_id, event_type, y, b FROM h WHERE b > y OR b IS NULL"


def _slices(df: DataFrame) -> DataFrame:
    return df.select("EventId", "EventType", F.col("ValidFrom").alias("A"), F.col("ValidTo").alias("B"))


@code("tmp4_update", f'WITH {_HIT} SELECT event_id AS "EventId", event_type AS "EventType", a AS A, b AS B FROM ({_OUTSIDE} UNION ALL SELECT event_id, \'held\', greatest(a, x), least(coalesce(b, y), y) FROM h)')
def _(e: Engine) -> DataFrame:
    s = e.model.set("UserStates")
    return _slices(temporal.touched(temporal.update(s.load(e.spark), s.timeline, [_DELTA]), s.timeline))


@code("tmp6_delete", f'WITH {_HIT} SELECT event_id AS "EventId", event_type AS "EventType", a AS A, b AS B FROM ({_OUTSIDE})')
def _(e: Engine) -> DataFrame:
    s = e.model.set("UserStates")
    return _slices(temporal.touched(temporal.delete(s.load(e.spark), s.timeline, [_DELTA]), s.timeline))


@code("tmp6_removed_periods", f'WITH {_HIT} SELECT user_id AS "UserId", greatest(a, x) AS "ValidFrom", least(coalesce(b, y), y) AS "ValidTo" FROM h')
def _(e: Engine) -> DataFrame:
    s = e.model.set("UserStates")
    return temporal.removed_periods(s.load(e.spark), s.timeline, _DELTA)


# --- changes and sync ---
def _versions(e: Engine) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three deterministic variants of the customers: a base, and two sides that changed it."""
    base = e.model.set("Customers").load(e.spark).select("Custkey", "Name", "Acctbal", "Mktsegment")
    k = F.col("Custkey")
    mine = base.where(k % 13 != 0).withColumn("Acctbal", F.when(k % 5 == 0, F.lit(1.5)).otherwise(F.col("Acctbal"))).withColumn("Name", F.when(k % 7 == 0, F.lit("mine")).otherwise(F.col("Name")))
    theirs = base.where(k % 17 != 0).withColumn("Mktsegment", F.when(k % 3 == 0, F.lit("theirs")).otherwise(F.col("Mktsegment"))).withColumn("Name", F.when(k % 2 == 0, F.lit("theirs")).otherwise(F.col("Name")))
    return base, mine, theirs


@code("chg2_diff", "SELECT c_custkey AS Custkey, CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'mine' ELSE c_name END END AS Name, CASE WHEN c_custkey % 13 = 0 THEN 'deleted' ELSE 'updated' END AS change FROM customer WHERE c_custkey % 13 = 0 OR (c_custkey % 5 = 0 AND c_acctbal <> 1.5) OR c_custkey % 7 = 0")
def _(e: Engine) -> DataFrame:
    base, mine, _ = _versions(e)
    return changes.snapshot_changes(base, mine, ["Custkey"]).select("Custkey", "Name", F.col("_change").alias("change"))


@code("chg3_delta_read", "SELECT c_custkey AS Custkey, CASE WHEN c_custkey % 13 = 0 THEN 'deleted' WHEN CASE WHEN c_custkey % 5 = 0 THEN 1.5 ELSE c_acctbal END > 100 THEN NULL ELSE 'changed' END AS removed FROM customer WHERE c_custkey % 13 = 0 OR (c_custkey % 5 = 0 AND c_acctbal <> 1.5) OR c_custkey % 7 = 0")
def _(e: Engine) -> DataFrame:
    base, mine, _ = _versions(e)
    found = changes.delta_read(changes.snapshot_changes(base, mine, ["Custkey"]), F.col("Acctbal") > 100)
    return found.select("Custkey", F.col("_removed").alias("removed"))


@code("chg6_log", "SELECT user_id AS \"UserId\", max_by(value, event_id) AS \"Value\", CASE WHEN max_by(event_type, event_id) = 'error' THEN 'deleted' ELSE 'updated' END AS change FROM events WHERE event_id > 100 GROUP BY 1")
def _(e: Engine) -> DataFrame:
    log = e.model.set("Events").load(e.spark).select("UserId", "Value", F.col("EventId").alias("_version"), F.when(F.col("EventType") == "error", "delete").otherwise("update").alias("_op"))
    found = changes.log_changes(log, ["UserId"], 100)
    kept = log.groupBy("UserId").agg(F.max_by("Value", "_version").alias("Value"))
    return found.drop("Value").join(kept, "UserId").select("UserId", "Value", F.col("_change").alias("change"))


@code("chg5_replay", "SELECT c_custkey AS Custkey, CASE WHEN c_custkey % 7 = 0 THEN 'mine' ELSE c_name END AS Name, CASE WHEN c_custkey % 5 = 0 THEN 1.5 ELSE c_acctbal END AS Acctbal FROM customer WHERE c_custkey % 13 <> 0")
def _(e: Engine) -> DataFrame:
    base, mine, _ = _versions(e)
    return changes.replay(base, changes.snapshot_changes(base, mine, ["Custkey"]), ["Custkey"]).select("Custkey", "Name", "Acctbal")


_BOTH = "SELECT c_custkey AS k, c_name AS n0, c_custkey % 13 = 0 AS dl, c_custkey % 17 = 0 AS dr, CASE WHEN c_custkey % 7 = 0 THEN 'mine' ELSE c_name END AS nl, CASE WHEN c_custkey % 2 = 0 THEN 'theirs' ELSE c_name END AS nr, CASE WHEN c_custkey % 5 = 0 THEN 1.5 ELSE c_acctbal END AS al, c_acctbal AS a0, CASE WHEN c_custkey % 3 = 0 THEN 'theirs' ELSE c_mktsegment END AS mr, c_mktsegment AS m0 FROM customer"


@code("syn2_merge_fields", f"SELECT k AS Custkey, CASE WHEN nl <> n0 AND nr <> n0 THEN nr WHEN nl <> n0 THEN nl ELSE nr END AS Name, al AS Acctbal, mr AS Mktsegment FROM ({_BOTH}) WHERE NOT dl AND NOT dr")
def _(e: Engine) -> DataFrame:
    base, mine, theirs = _versions(e)
    merged = merge.three_way(base, mine, theirs, ["Custkey"], "fields")
    return merged.where((F.col("Custkey") % 13 != 0) & (F.col("Custkey") % 17 != 0)).select("Custkey", "Name", "Acctbal", "Mktsegment")


for _rule in ("remote", "local"):
    _win, _lose = ("r", "l") if _rule == "remote" else ("l", "r")
    _values = {"r": ("nr", "a0", "mr"), "l": ("nl", "al", "m0")}
    _pick = lambda i: f"CASE WHEN NOT cl THEN {_values['r'][i]} WHEN NOT cr THEN {_values['l'][i]} ELSE {_values[_win][i]} END"  # noqa: E731, B023
    SQL[f"syn2_merge_{_rule}"] = f"SELECT k AS Custkey, {_pick(0)} AS Name, {_pick(1)} AS Acctbal, {_pick(2)} AS Mktsegment FROM (SELECT *, dl OR nl <> n0 OR al <> a0 AS cl, dr OR nr <> n0 OR mr <> m0 AS cr FROM ({_BOTH})) WHERE NOT CASE WHEN NOT cl THEN dr WHEN NOT cr THEN dl ELSE d{_win} END"

    def _merged(spark: SparkSession, sf_dir: str, rule: str = _rule) -> DataFrame:
        base, mine, theirs = _versions(engine(spark, sf_dir))
        return merge.three_way(base, mine, theirs, ["Custkey"], rule).where("_outcome <> 'deleted'").drop("_outcome")

    QUERIES[f"syn2_merge_{_rule}"] = _merged


@code("syn4_vectors", "SELECT c_custkey AS Custkey, 'a:' || greatest(c_custkey % 5, c_custkey % 3) || ',b:' || greatest(c_custkey % 2, 1) AS merged, CASE WHEN (c_custkey % 5 > c_custkey % 3 OR c_custkey % 2 > 1) AND (c_custkey % 5 < c_custkey % 3 OR c_custkey % 2 < 1) THEN 'concurrent' WHEN c_custkey % 5 > c_custkey % 3 OR c_custkey % 2 > 1 THEN 'after' WHEN c_custkey % 5 < c_custkey % 3 OR c_custkey % 2 < 1 THEN 'before' ELSE 'same' END AS relation FROM customer")
def _(e: Engine) -> DataFrame:
    k = F.col("Custkey")
    a = merge.parse_vector(F.concat(F.lit("a:"), (k % 5).cast("string"), F.lit(",b:"), (k % 2).cast("string")))
    b = merge.parse_vector(F.concat(F.lit("a:"), (k % 3).cast("string"), F.lit(",b:1")))
    return e.model.set("Customers").load(e.spark).select("Custkey", merge.vector_text(merge.merge_vectors(a, b)).alias("merged"), merge.compare_vectors(a, b).alias("relation"))


@code("syn8_reconcile", "SELECT c_custkey AS Custkey, CASE WHEN c_custkey % 17 = 0 THEN 'here' ELSE 'there' END AS only FROM customer WHERE (c_custkey % 13 = 0) <> (c_custkey % 17 = 0)")
def _(e: Engine) -> DataFrame:
    _, mine, theirs = _versions(e)
    gone, new = merge.reconcile(mine.select("Custkey"), theirs.select("Custkey"), ["Custkey"])
    return gone.withColumn("only", F.lit("here")).unionByName(new.withColumn("only", F.lit("there")))


# --- writes ---
def _nations(e: Engine) -> DataFrame:
    return e.model.set("Nations").load(e.spark)


@code("dml1_insert", "SELECT n_nationkey AS Nationkey, n_name AS Name, n_regionkey AS Regionkey FROM nation UNION ALL SELECT m + k, x, 1 FROM (SELECT max(n_nationkey) AS m FROM nation), (VALUES (1, 'NEW A'), (2, 'NEW B')) v(k, x)")
def _(e: Engine) -> DataFrame:
    new = e.spark.createDataFrame([(None, "NEW A", 1), (None, "NEW B", 1)], "Nationkey int, Name string, Regionkey int")
    return writes.insert(_nations(e), new, ("Nationkey",))


@code("dml3_update", "SELECT n_nationkey AS Nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS Name, n_regionkey AS Regionkey FROM nation")
def _(e: Engine) -> DataFrame:
    return writes.update(_nations(e), F.col("Nationkey") == 3, {"Name": "X"}, ("Nationkey",))


@code("dml3_replace", "SELECT n_nationkey AS Nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS Name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS Regionkey FROM nation")
def _(e: Engine) -> DataFrame:
    return writes.replace(_nations(e), F.col("Nationkey") == 3, {"Name": "X"}, ("Nationkey",))


@code("dml4_upsert", "SELECT n_nationkey AS Nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS Name, n_regionkey AS Regionkey FROM nation UNION ALL SELECT 99, 'Y', NULL")
def _(e: Engine) -> DataFrame:
    return writes.upsert(_nations(e), e.spark.createDataFrame([(3, "X"), (99, "Y")], "Nationkey int, Name string"), ("Nationkey",))


@code("dml5_delete", "SELECT n_nationkey AS Nationkey FROM nation WHERE n_regionkey <> 2")
def _(e: Engine) -> DataFrame:
    return writes.delete(_nations(e), F.col("Regionkey") == 2).select("Nationkey")


@code("dml6_link", "SELECT DISTINCT l_partkey AS Partkey, l_suppkey AS Suppkey FROM lineitem WHERE l_suppkey <> 1 UNION SELECT 1, 0")
def _(e: Engine) -> DataFrame:
    bridge = e.model.set("Lineitems").load(e.spark).select("Partkey", "Suppkey").distinct()
    gone = bridge.where("Suppkey = 1")
    return writes.link(writes.unlink(bridge, gone), e.spark.createDataFrame([(1, 0)], "Partkey long, Suppkey long"))


@code("dml7_delta", "SELECT n_nationkey AS Nationkey, CASE WHEN n_nationkey = 4 THEN 'D' ELSE n_name END AS Name FROM nation WHERE n_nationkey <> 5")
def _(e: Engine) -> DataFrame:
    rows = e.spark.createDataFrame([(4, "D")], "Nationkey int, Name string")
    return writes.delta_payload(_nations(e), rows, e.spark.createDataFrame([(5,)], "Nationkey int"), ("Nationkey",)).select("Nationkey", "Name")


@code("dml8_each", "SELECT c_custkey AS Custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS Acctbal FROM customer")
def _(e: Engine) -> DataFrame:
    frame = e.frame("Customers")
    from ravelin.plans.parser import parse_expression

    return writes.update(frame.df, frame.compile(parse_expression("Acctbal lt 0 and Mktsegment eq 'BUILDING'")), {"Acctbal": 0.0}, ("Custkey",)).select("Custkey", "Acctbal")


# --- functions, metadata, builder ---
request("udf2_bound_function", "Parts/Tables.Cheapest(n=4)?$select=Partkey,Retailprice", "SELECT p_partkey AS Partkey, p_retailprice AS Retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 4")
request("cli1_builder", Query("Orders").filter((field("Totalprice") > 200000) & ~field("Orderstatus").isin("F", "P")).select("Orderkey").url, "SELECT o_orderkey AS Orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus NOT IN ('F', 'P')")
request("cli3_grouped", Query("Lineitems").group(["Linestatus"], orderby="N desc", limit=1, N="$count").url, "SELECT l_linestatus AS Linestatus, count(*) AS N FROM lineitem GROUP BY 1 ORDER BY N DESC, 1 LIMIT 1")


@code("src11_metadata", None)
def _(e: Engine) -> DataFrame:
    document = csdl.metadata(e.spark, e.model)
    rows = [(s, m, str(p.get("$Type"))) for s, t in document["Tables"].items() for m, p in t.items() if isinstance(p, dict)]
    return e.spark.createDataFrame(rows, "owner string, member string, type string")


@code("src10_service_document", None)
def _(e: Engine) -> DataFrame:
    return e.service_document()


@code("src15_json", None)
def _(e: Engine) -> DataFrame:
    return e.json("Nations?$expand=Region($select=Name)&$select=Name")


@code("src17_batch", "SELECT count(*) AS n FROM nation UNION ALL SELECT count(*) FROM region")
def _(e: Engine) -> DataFrame:
    answers = e.batch(["Nations", "Regions"])
    counts = [a.agg(F.count("*").alias("n")) for a in answers if isinstance(a, DataFrame)]
    return counts[0].unionByName(counts[1])


@code("srt5_page", "SELECT o_orderkey AS Orderkey FROM orders WHERE o_totalprice > 100000 ORDER BY 1 LIMIT 20")
def _(e: Engine) -> DataFrame:
    first = e.page("Orders?$filter=Totalprice gt 100000&$select=Orderkey", 10)
    return first.rows.unionByName(e.page(first.next_link or "", 10).rows)


from ravelin import queries_edge  # noqa: E402, F401  registers more
