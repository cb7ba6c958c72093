"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

from re import _constants as K
from re import _parser

#: Sets of exact strings larger than this are given up and their trigrams used.
MOST = 64


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def minimal(clauses: set[frozenset[str]]) -> list[frozenset[str]]:
    """An OR of ANDs without clauses that another one implies."""
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def derive(pattern: str) -> list[list[frozenset[str]]]:
    """The query of ``pattern`` over lower-cased text: AND of ORs of AND-sets of trigrams; empty if no trigram is mandatory."""
    out: list[list[frozenset[str]]] = []
    exact = _walk(_parser.parse(pattern), out)
    _flush(exact, out)
    return out


def _flush(exact: set[str], out: list) -> None:
    if exact and all(len(s) >= 3 for s in exact):
        query = minimal({trigrams(s) for s in exact})
        if query not in out:
            out.append(query)


def _walk(items, out: list) -> set[str]:
    """Strings one of which ends what has been read so far; conditions met on the way go to ``out``."""
    exact = {""}
    for op, arg in items:
        part = _part(op, arg, out)
        if part is None or len(exact) * len(part) > MOST:
            _flush(exact, out)
            exact = part if part is not None and len(part) <= MOST else {""}
        else:
            exact = {a + b for a in exact for b in part}
    return exact


def _part(op, arg, out: list) -> set[str] | None:
    """The exact lower-cased strings of one item, or None where there are too many."""
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN:
        chars = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                chars.add(chr(value).lower())
            elif kind is K.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is K.SUBPATTERN:
        return _exact(arg[3], out)
    if op is K.BRANCH:
        found = set()
        for branch in arg[1]:
            own: list = []
            strings = _exact(branch, own)
            if strings is None:
                return None
            found |= strings
        return found if len(found) <= MOST else None
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, item = arg
        if (least, most) == (0, 1):
            strings = _exact(item, [])
            return None if strings is None else strings | {""}
        if least == most == 1:
            return _exact(item, out)
        return None
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {""}
    return None


def _exact(items, out: list) -> set[str] | None:
    found = {""}
    for op, arg in items:
        part = _part(op, arg, out)
        if part is None:
            return None
        found = {a + b for a in found for b in part}
        if len(found) > MOST:
            return None
    return found
