"""$search: case- and accent-insensitive substrings of the searchable strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.errors import unsupported
from ravelin.operators.frame import Frame, c
from ravelin.plans.tree import Search, Term


def matches(frame: Frame, node: Term | Search) -> Column:
    if frame.set is None:
        raise unsupported("search on grouped rows")
    names = frame.set.searchable
    if names is None:
        names = tuple(f.name for f in frame.df.schema.fields if isinstance(f.dataType, T.StringType) and f.name in frame.shape)
    folded = [F.collate(c(n), "UNICODE_CI_AI") for n in names]

    def go(n: Term | Search) -> Column:
        if isinstance(n, Term):
            found = F.lit(False)
            for column in folded:
                found |= F.coalesce(F.contains(column, F.collate(F.lit(n.text), "UNICODE_CI_AI")), F.lit(False))
            return found
        parts = [go(p) for p in n.parts]
        out = parts[0]
        if n.op == "NOT":
            return ~out
        for p in parts[1:]:
            out = out & p if n.op == "AND" else out | p
        return out

    return go(node)
