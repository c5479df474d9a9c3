"""Name matching: match types, anchored patterns, empty-query rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of match types.
_KINDS = {
    "equals": "equals", "equal": "equals", "contains": "contains",
    "starts_with": "prefix", "startswith": "prefix", "start_with": "prefix",
    "ends_with": "suffix", "endswith": "suffix", "end_with": "suffix",
    "regex": "similar", "similar_regex": "similar",
}


def match(col: str | Column, query: str, match_type: str = "contains", ignore_case: bool = False) -> Column:
    """A boolean column. An unknown match type means contains; a similar regex has only ^ and $ as anchors."""
    c = F.col(col) if isinstance(col, str) else col
    kind = _KINDS.get(match_type.lower(), "contains")
    if kind == "similar":
        start, end = query.startswith("^"), query.endswith("$")
        query = query[1:] if start else query
        query = query[:-1] if end and query.endswith("$") else query
        kind = {(True, True): "equals", (True, False): "prefix", (False, True): "suffix", (False, False): "contains"}[start, end]
    if ignore_case:
        c, query = F.lower(c), query.lower()
    q = F.lit(query)
    return {"equals": c == q, "prefix": c.startswith(q), "suffix": c.endswith(q), "contains": F.contains(c, q)}[kind]


def all_match(strings: Column, queries: list[str], match_type: str = "contains", ignore_case: bool = False) -> Column:
    """Every query is matched by some string of the array; no query is matched vacuously."""
    found = [F.exists(strings, _matcher(q, match_type, ignore_case)) for q in queries]
    return reduce(lambda a, b: a & b, found, F.lit(True))


def _matcher(q: str, match_type: str, ignore_case: bool) -> Callable[[Column], Column]:
    return lambda s: match(s, q, match_type, ignore_case)
