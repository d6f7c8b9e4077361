"""Scalar functions as Column builders; null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM = r"(?U)^\s+|\s+$"

FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "contains": (2, 2, lambda a, b: F.contains(a, b)),
    "startswith": (2, 2, lambda a, b: F.startswith(a, b)),
    "endswith": (2, 2, lambda a, b: F.endswith(a, b)),
    "tolower": (1, 1, F.lower),
    "toupper": (1, 1, F.upper),
    "length": (1, 1, F.length),
    "indexof": (2, 2, lambda a, b: F.position(b, a) - 1),
    "substring": (2, 3, lambda s, i, n=None: F.substr(s, i + 1) if n is None else F.substr(s, i + 1, n)),
    "trim": (1, 1, lambda a: F.regexp_replace(a, TRIM, "")),
    "concat": (2, 2, F.concat),
    "year": (1, 1, F.year),
    "month": (1, 1, F.month),
    "day": (1, 1, F.dayofmonth),
    "hour": (1, 1, F.hour),
    "minute": (1, 1, F.minute),
    "second": (1, 1, F.second),
    "date": (1, 1, F.to_date),
    "floor": (1, 1, F.floor),
    "ceiling": (1, 1, F.ceil),
    "round": (1, 1, lambda a: F.round(a, 0)),
}
BOOLEAN = frozenset({"contains", "startswith", "endswith", "matchesPattern", "isof", "isdefined"})
UNSUPPORTED = frozenset({"fractionalseconds", "time", "totaloffsetminutes", "totalseconds", "case", "maxdatetime", "mindatetime", "hassubset", "hassubsequence"})
