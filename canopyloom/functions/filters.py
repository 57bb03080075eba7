"""The composite filter: conditions on text, path and category, joined by AND; without any, all rows pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_filter(text: Column, must: Sequence[str] = (), any_of: Sequence[str] = (), must_not: Sequence[str] = ()) -> Column:
    """Case-insensitive substrings."""
    low = F.lower(text)
    has = [low.contains(k.lower()) for k in must]
    clauses = has + [~low.contains(k.lower()) for k in must_not]
    if any_of:
        clauses.append(reduce(or_, (low.contains(k.lower()) for k in any_of)))
    return reduce(and_, clauses, F.lit(True))


def scope_filter(path: Column, prefixes: Sequence[str] = ()) -> Column:
    """Plain prefixes of the path; an empty path passes."""
    return reduce(or_, (path.startswith(p) for p in prefixes), path == "") if prefixes else F.lit(True)


def community_filter(community: Column, ids: Sequence[str] = ()) -> Column:
    return community.isin(list(ids)) if ids else F.lit(True)


def composite(text: Column, path: Column, community: Column, must=(), any_of=(), must_not=(), prefixes=(), ids=()) -> Column:
    return keyword_filter(text, must, any_of, must_not) & scope_filter(path, prefixes) & community_filter(community, ids)
