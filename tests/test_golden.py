"""Row ids of filters under both null regimes, on the marina: each list follows from SURVEY section 1.3 by hand."""

from __future__ import annotations

import pytest

from ravelin.engine import Engine
from tests.fixtures import marina

GOLDEN = {
    "Boats": [
        # Functions and bare Booleans are three-valued: a null condition drops the row, also under not.
        ("contains(Rig,'sloop')", "1 4 7"),
        ("not contains(Rig,'sloop')", "2 6"),
        ("not Sold", "1 2 5"),
        ("Sold or not Sold", "1 2 3 5 7"),
        ("not (Sold or Length gt 10)", "1 5"),
        ("not (Sold and Length gt 10)", "1 2 3 4 5 7"),
        ("startswith(tolower(Title),'heron') and not endswith(Title,'II')", "1"),
        ("trim(Title) eq 'Tern'", "4"),
        ("matchesPattern(Title,'^[Hh]eron')", "1 2"),
        # Comparisons are two-valued: false with a null operand (ne: true).
        ("not (Sold eq true)", "1 2 4 5 6"),
        ("Sold ne true", "1 2 4 5 6"),
        ("Sold eq null", "4 6"),
        ("Length lt 10", "1 3 7"),
        ("not (Length ge 10)", "1 3 4 5 7"),
        ("Rig ne 'sloop'", "2 3 5 6 7"),
        ("Length in (9.5,7,null)", "1 3 4 5 7"),
        ("not (Length in (9.5))", "2 4 5 6 7"),
        ("Length div 0 eq null", "1 2 3 4 5 6 7"),
        ("Harbour eq null", "5 7"),
        ("Harbour/City eq 'Ostend'", "1 2"),
        ("not (Harbour/City eq 'Brest')", "1 2 3 4 5 7"),
        ("Harbour/City eq null", "3 4 5 7"),
        # Collections.
        ("Riggers/any(r:r/Country eq 'IT')", "1 6"),
        ("not Riggers/any(r:r/Country eq 'IT')", "2 3 4 5 7"),
        ("not Riggers/any()", "4 5 7"),
        ("Riggers/all(r:r/Country ne null)", "3 4 5 7"),
        ("Riggers/$count ge 2", "1 6"),
    ],
    "Harbours": [
        ("Boats/any(b:contains(b/Rig,'sloop'))", "10 20"),
        ("not Boats/any(b:contains(b/Rig,'sloop'))", "30 40"),
        ("Boats/any(b:not contains(b/Rig,'ketch'))", "10 20 30"),
        ("Boats/all(b:contains(b/Rig,'sloop'))", "40"),
        ("not Boats/all(b:contains(b/Rig,'sloop'))", "10 30"),
        ("Boats/aggregate(Length with max) gt 10", "10 30"),
        ("Boats/$count($filter=Sold) eq 1", "20"),
    ],
    "Crew": [
        # A collection through a null to-one is null.
        ("Boss/Reports/any()", "2 3 4 5"),
        ("not Boss/Reports/any()", ""),
        ("Boss/Reports/any(r:r/Name eq 'Yuki')", "4 5"),
        ("not Boss/Reports/any(r:r/Name eq 'Yuki')", "2 3"),
        ("Boss/Reports/$count eq 0", ""),
        ("Boss/Reports/$count gt 1", "2 3 4 5"),
        ("isof(Default.Skipper)", "1 2"),
        ("not (Default.Skipper/Pay gt 500)", "2 3 4 5"),
        ("Joined le 2022-01-01T01:00:00+01:00", "1 2 3"),
        ("Joined lt 2022-01-01T01:00:00+01:00", "1 2"),
        ("year(Joined) eq 2022", "3 5"),
        ("not (month(Joined) eq 6)", "1 2 3 4"),
        ("date(Joined) eq 2021-12-31", "2"),
        ("Default.isleaf(HierarchyNodes=$root/Crew,HierarchyQualifier='Watch',Node=Id)", "3 4 5"),
        ("Default.issibling(HierarchyNodes=$root/Crew,HierarchyQualifier='Watch',Node=Id,Other=4)", "5"),
    ],
    "Buoys": [
        ("Lights has Default.Lamps'White'", "1 4"),
        ("not (Lights has Default.Lamps'Red,White')", "2"),
        ("Sounds/any(s:s eq 'bell')", "1 4"),
        ("Sounds/any()", "1 4"),
        ("Sounds/all(s:contains(s,'l'))", "2"),
        ("Depths/any(d:d mod 3 eq 1)", "1 2"),
        ("Depths/any(d:d div 2 eq 3)", "1"),
        ("Depths/any(d:d divby 2 eq 3.5)", "1"),
        ("Depths/any(d:d in (5,9))", "4"),
        ("Depths/any(d:d in (null))", "4"),
        ("Depths/any(d:d ne 4)", "1 4"),
        ("Depths/any(d:not (d gt 4))", "1 2 4"),
        ("Depths/$count($filter=$this gt 4) eq 2", "1"),
    ],
    "Rates": [("Amount mod 25 eq 10", "2")],
}
CASES = [(s, condition, ids) for s, cases in GOLDEN.items() for condition, ids in cases]


@pytest.mark.parametrize(("entity_set", "condition", "ids"), CASES, ids=[f"{s}-{x[:50]}" for s, x, _ in CASES])
def test_ids(spark, entity_set, condition, ids):
    rows = Engine(spark, marina()).query(f"{entity_set}?$filter={condition}")
    assert " ".join(str(r[0]) for r in sorted(rows.select(rows.columns[0]).collect())) == ids


@pytest.mark.parametrize(
    ("request_", "expected"),
    [
        ("Boats?$orderby=Length&$top=3&$select=Hull", [(4,), (5,), (7,)]),
        ("Boats?$orderby=Length desc&$top=2&$skip=5&$select=Hull", [(4,), (5,)]),
        ("Boats(6)/Harbour?$select=Label", [("Basin",)]),
        ("Boats(7)/Harbour", []),
        ("Crew/Default.Skipper?$select=Id&$orderby=Id", [(1,), (2,)]),
        ("Crew?$apply=ancestors($root/Crew,Watch,Id,Name eq 'Zora',keep start)&$select=Id&$orderby=Id", [(1,), (2,), (5,)]),
        ("Crew?$apply=traverse($root/Crew,Watch,Id,postorder,Name desc)&$top=9&$select=Id", [(3,), (5,), (4,), (2,), (1,)]),
        ("Boats?$apply=aggregate(Harbour/City with countdistinct as N,Length with max as M)", [(2, 22)]),
        ("Harbours?$apply=outerjoin(Boats as B)/groupby((Label),aggregate($count as N))&$orderby=Label", [("Basin", 1), ("Empty Dock", 1), ("Mole", 2), ("North Quay", 2)]),
        ("Boats?$apply=topsum(30,Length)&$select=Hull&$orderby=Hull", [(2,), (6,)]),
        ("Boats?$search=sloop&$select=Hull&$orderby=Hull", [(1,), (4,), (7,)]),
        ("Rates?$at=2023-05-15T00:00:00Z&$select=Id&$orderby=Id", [(2,), (4,)]),
        ("Rates?$at=2023-08-01T00:00:00Z&$select=Id&$orderby=Id", [(4,)]),
    ],
)
def test_rows(spark, request_, expected):
    assert [tuple(r) for r in Engine(spark, marina()).query(request_).collect()] == expected


def test_expand(spark):
    rows = Engine(spark, marina()).query("Harbours?$expand=Boats($filter=Length gt 8;$orderby=Length desc;$top=1;$count=true;$select=Hull)&$orderby=HarbourId").collect()
    assert [(r["HarbourId"], r["Boats@count"], [b["Hull"] for b in r["Boats"]]) for r in rows] == [(10, 2, [2]), (20, 1, [3]), (30, 1, [6]), (40, 0, [])]
    one = Engine(spark, marina()).query("Boats?$expand=Harbour($select=Label)&$filter=Hull in (3,5)&$orderby=Hull").collect()
    assert [r["Harbour"] and r["Harbour"]["Label"] for r in one] == ["Mole", None]
