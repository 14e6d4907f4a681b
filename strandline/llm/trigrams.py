"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is True (no mandatory trigram), a trigram, or ("and" | "or", queries).
Everything is lower-cased, so the queries are read against lower-cased texts.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

Query = bool | str | tuple
#: Strings that a piece of a pattern may stand for before it counts as open.
MOST = 16


def _and(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of(strings: set[str]) -> Query:
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _item(code, value) -> tuple[set[str] | None, Query]:
    """The strings an item stands for, or None and what its matches must hold."""
    if code is op.LITERAL:
        return {chr(value).lower()}, True
    if code is op.IN:
        chars = {chr(v).lower() for c, v in value if c is op.LITERAL}
        return (chars, True) if len(chars) <= 8 and all(c is op.LITERAL for c, _ in value) else (None, True)
    if code in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}, True
    if code is op.SUBPATTERN:
        return _sequence(value[-1])
    if code is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(x[0] is not None for x in parts):
            return set().union(*(x[0] for x in parts)), True
        return None, _or([_of(s) if s is not None else q for s, q in parts])
    if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        if (low, high) == (1, 1):
            return strings, query
        if low == high and strings is not None and len(strings) ** low <= MOST:
            return {"".join(p) for p in product(sorted(strings), repeat=low)}, True
        return None, True if low == 0 else _of(strings) if strings is not None else query
    return None, True


def _sequence(items) -> tuple[set[str] | None, Query]:
    run, closed, whole = {""}, [], True
    for code, value in items:
        strings, query = _item(code, value)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        closed += [_of(run), query]
        run, whole = (strings, False) if strings is not None else ({""}, False)
    return (run, True) if whole else (None, _and([*closed, _of(run)]))


def trigram_query(pattern: str) -> Query:
    """The query of a pattern in Python's syntax."""
    strings, query = _sequence(parser.parse(pattern))
    return _of(strings) if strings is not None else query


def trigrams_of(query: Query) -> set[str]:
    """All trigrams in a query."""
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))
