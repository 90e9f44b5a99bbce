"""Boolean trigram queries that any text matching a regular expression must satisfy."""

from __future__ import annotations

import re
import warnings
from itertools import product

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _parser as sre

#: A class of more letters counts as open; a run of literals is cut where it has more spellings than this, and what it had so far counts.
MAX_CLASS, MAX_SPELLINGS = 16, 64


def _spellings(items) -> list[set[str] | None]:
    """For a sequence of parsed items: the finite set of strings of each, or None where it is open."""
    out: list[set[str] | None] = []
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(arg).lower()})
        elif name == "IN":
            letters = _letters(arg)
            out.append(letters if letters and len(letters) <= MAX_CLASS else None)
        elif name == "SUBPATTERN":
            out.extend(_spellings(arg[3]))
        elif name == "BRANCH":
            ways = [_whole(_spellings(way)) for way in arg[1]]
            out.append(None if None in ways else set().union(*ways))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
            inner = _whole(_spellings(arg[2]))
            out.append(None if inner is None else inner | ({""} if arg[0] == 0 else set()))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            # As many copies as always occur, then an open end where there may be more.
            inner = _whole(_spellings(arg[2]))
            out.extend([inner] * min(arg[0], 8))
            if arg[1] != arg[0] or arg[0] > 8:
                out.append(None)
        else:
            out.append(None)
    return out


def _letters(members) -> set[str] | None:
    """The letters of a class of single characters and ranges, in lower case; None where it has anything else."""
    out: set[str] = set()
    for op, arg in members:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < 64:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _whole(parts: list[set[str] | None]) -> set[str] | None:
    if None in parts:
        return None
    size = 1
    for part in parts:
        size *= len(part)
    return {"".join(x) for x in product(*parts)} if size <= MAX_SPELLINGS else None


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives, each a list of lower-case trigrams that all occur; empty: no trigram is mandatory."""
    best: list[list[str]] = []
    run: list[set[str]] = []
    for part in [*_spellings(sre.parse(pattern)), None]:
        if part is not None and _whole([*run, part]) is not None:
            run.append(part)
            continue
        clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in (_whole(run) or set())}
        if clauses and frozenset() not in clauses:
            least = [c for c in clauses if not any(d < c for d in clauses)]
            # The run whose weakest alternative asks for most trigrams; of equals the one with fewer alternatives.
            if not best or (min(map(len, least)), -len(least)) > (min(map(len, best)), -len(best)):
                best = sorted(sorted(c) for c in least)
        run = _tail(run, part) if part is not None else []
    return best


def _tail(run: list[set[str]], part: set[str]) -> list[set[str]]:
    """The longest end of a run that can still go on with part; what was cut has counted already."""
    if _whole([part]) is None:
        return []
    while _whole([*run, part]) is None:
        run = run[1:]
    return [*run, part]
