"""Boolean trigram queries that every match of a regular expression implies.

A query is a list of clauses, all of which must hold; a clause is a list of trigram sets, one of which must be
present as a whole. Texts and queries are lowered, so a query may let more through than the pattern, never less.
"""

from __future__ import annotations

import re
from itertools import product

STRINGS = 64  # strings an exact part is followed up to

Query = list[list[frozenset[str]]]


def grams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def clause(strings: set[str]) -> Query:
    """One of the strings occurs. A string without a trigram says nothing, and so does the clause then."""
    sets = {grams(s) for s in strings}
    if not strings or frozenset() in sets:
        return []
    return [sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)]


def parts(nodes) -> tuple[set[str] | None, Query]:
    """All strings a sequence can match, if they are few; else None, and what its matches imply."""
    exact: set[str] = {""}
    query: Query = []
    whole = True
    for kind, value in nodes:
        found, implied = part(str(kind), value)
        query += implied
        joined = {a + b for a, b in product(exact, found)} if found else None
        if joined is not None and len(joined) <= STRINGS:
            exact = joined
        else:
            query += clause(exact)
            exact, whole = found or {""}, False
    if whole:
        return exact, query
    return None, query + clause(exact)


def part(kind: str, value) -> tuple[set[str] | None, Query]:
    if kind == "LITERAL":
        return {chr(value).lower()}, []
    if kind == "SUBPATTERN":
        return parts(value[-1])
    if kind == "BRANCH":
        options = [parts(x) for x in value[1]]
        if all(e is not None for e, _ in options):
            strings = set().union(*[e for e, _ in options])
            return (strings, []) if len(strings) <= STRINGS else (None, clause(strings))
        return None, []
    if kind == "IN":
        points = [v for k, v in value if str(k) == "LITERAL"]
        return ({chr(v).lower() for v in points}, []) if len(points) == len(value) else (None, [])
    if kind in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, nodes = value
        exact, query = parts(nodes)
        if exact is not None and int(high) <= 1:
            return exact | ({""} if low == 0 else set()), query if low else []
        if low == 0:
            return None, []
        return None, query + (clause(exact) if exact is not None else [])
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, []
    return None, []


def trigram_query(pattern: str) -> Query:
    """What a text must hold for ``pattern`` to match; empty if the pattern has no mandatory trigram."""
    exact, query = parts(re._parser.parse(pattern))
    return query + (clause(exact) if exact is not None else [])
