"""Parsers, writers, errors, patterns and the builder."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.builder import Query, field
from ravelin.engine import Engine
from ravelin.errors import QueryError
from ravelin.functions.patterns import like_to_java, to_java
from ravelin.plans.parser import parse_apply, parse_expression, parse_options, parse_request, parse_search
from ravelin.plans.tree import Binary, Call, Items, Literal, Path, Unary, sequence_text
from tests.fixtures import marina

names = st.sampled_from(["A", "B", "Nav/C"]).map(lambda n: Path(tuple(n.split("/"))))
leaves = names | st.integers(-9, 99).map(lambda n: Literal(n, "int")) | st.text("ab' ", max_size=4).map(lambda t: Literal(t, "string")) | st.sampled_from([Literal(None, "null"), Literal(True, "bool")])
nodes = st.recursive(
    leaves,
    lambda inner: st.builds(Binary, st.sampled_from("or and eq ne gt ge lt le add sub mul div divby mod".split()), inner, inner) | st.builds(Unary, st.just("not"), inner) | st.builds(lambda x: Call("length", (x,)), inner) | st.builds(lambda a, xs: Binary("in", a, Items(tuple(xs))), names, st.lists(leaves.filter(lambda x: isinstance(x, Literal)), min_size=1, max_size=3)),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(nodes)
def test_round_trip(node):
    assert parse_expression(str(node)) == node


def test_precedence():
    assert parse_expression("a or b and c eq d add e mul f") == parse_expression("a or (b and (c eq (d add (e mul f))))")
    assert str(parse_expression("(a add b) mul c")) == "(a add b) mul c"
    assert str(parse_search('a b OR NOT "c d"')) == 'a AND b OR NOT "c d"'


def test_apply_round_trip():
    text = "filter(A gt 3)/groupby((B,C/D),topcount(2,E)/aggregate(E with sum as T,$count as N))/concat(identity,compute(T mul 2 as U))"
    assert sequence_text(parse_apply(text)) == text
    options = parse_options("$filter=A eq 'x&y'&$expand=N($select=P;$top=3),M/$count&$orderby=A desc,B&$top=5&$count=true")
    assert parse_options(str(options)) == options
    assert [s.name for s in parse_request("Set(1)/Nav(k='a/b')/$count").segments] == ["Set", "Nav", "$count"]


@pytest.mark.parametrize(
    ("url", "status"),
    [
        ("Boats?$filter=Nope eq 1", 400), ("Boats?$filter=Length gt", 400), ("Boats?$apply=groupby((rollup(A,B)))", 501), ("Boats?$apply=nest(X)", 501), ("Boats?$apply=aggregate(Length with sum from A as B)", 501),
        ("Boats?$filter=geo.distance(A,B) lt 3", 501), ("Nothing", 404), ("Boats(null)", 400), ("Boats?$top=-1", 400), ("Boats?$filter=Riggers eq 1", 400), ("Boats?$filter=time(Length) eq 1", 501),
        ("Boats?$apply=groupby((Harbour))", 501), ("Boats?$apply=join(Harbour as K)", 400), ("Boats?$apply=aggregate($count as N)/join(Riggers as S)", 501), ("Boats?$apply=concat(identity,aggregate($count as N))", 501),
        ("Boats?$apply=aggregate($count as N)&$expand=Harbour", 400), ("Boats?$filter=Title in (Rig)", 501), ("Boats?$index=1", 501), ("Boats?$filter=A eq 1&$filter=B eq 2", 400), ("Boats?$apply=concat(identity)", 400),
        ("Boats?$filter=cast(Length,Edm.Int32) eq 1", 501), ("Harbours?$filter=Boats/aggregate(Title with sum) gt 1", 400), ("Boats?$from=2024-01-01&$to=2024-01-02&$toInclusive=2024-01-03&$select=Hull", None), ("Rates?$to=2024-01-02", 400),
    ],
)
def test_errors(spark, url, status):
    engine = Engine(spark, marina())
    if status is None:
        assert engine.query(url).count() == 7
        return
    with pytest.raises(QueryError) as e:
        engine.query(url)
    assert e.value.status == status


def test_patterns():
    assert to_java("a.c$") == r"a[^\n\r\u2028\u2029]c\z"
    assert to_java(r"[\s]") .startswith(r"[\t\n")
    assert to_java("[^]") == "(?s:.)"
    assert re.fullmatch(like_to_java("a*b?").replace(r"\z", r"\Z"), "a\nxbz")
    with pytest.raises(QueryError):
        to_java("(")
    with pytest.raises(QueryError):
        to_java("[a")


def test_builder():
    q = Query("Orders").filter(field("A").isin(1, 2)).filter(field("B").call("startswith", "x")).orderby("A desc").top(3).expand("N", Query("").select("P"))
    assert q.url == "Orders?$filter=A in (1,2) and startswith(B,'x')&$orderby=A desc&$top=3&$expand=N($select=P)"
    assert (field("A").isin(1, 2)).text("4.0") == "A eq 1 or A eq 2"
    with pytest.raises(QueryError):
        field("A").call("matchesPattern", "x").text("4.0")
    assert Query("S").group(["A"], having="N gt 1", N="$count").url == "S?$apply=groupby((A),aggregate($count as N))/filter(N gt 1)"


def test_explain(spark):
    text = Engine(spark, marina()).explain("Boats(1)/Riggers?$filter=Country eq 'x'&$orderby=Country&$top=2&$select=Country")
    assert [line.strip().partition("(")[0] for line in text.splitlines()] == ["Project", "Slice", "Sort", "Select", "Follow", "Key", "Scan"]
