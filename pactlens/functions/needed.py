"""Literals that a text must hold for a regular expression to match it.

To look for a few literals takes a fraction of the time of a regular expression that
matches nowhere, so a pattern is tried on those texts alone that hold one of them.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may follow a backslash, and a parenthesis with a question mark; other syntax may mean something else in Java.
ESCAPES, GROUPS = "sSdDwWb.-$%()[]/+*?|^{}", (":", "=", "!")


def needed(pattern: str) -> list[str] | None:
    """One of these literals is in every text that the pattern matches; None: not known."""
    escapes = re.findall(r"\\(.)", pattern, re.S)
    groups = re.findall(r"\(\?(.)", re.sub(r"\\.", "", pattern, flags=re.S), re.S)
    classes = re.findall(r"\[[^\]]*", re.sub(r"\\.", "", pattern, flags=re.S))
    if any(e not in ESCAPES for e in escapes) or any(g not in GROUPS for g in groups) or "(*" in pattern or any("&&" in c or "[" in c[1:] for c in classes):
        return None
    try:
        return _of(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None


def _worth(found: list[str] | None) -> int:
    return min(map(len, found)) if found else 0


def _of(parts) -> list[str] | None:
    """The best of: runs of characters in a row, and what a part of its own needs."""
    best, run = None, ""
    for op, value in [*parts, (None, None)]:
        if op is C.LITERAL:
            run += chr(value)
            continue
        here = [[run]] if run else []
        run = ""
        if op is C.SUBPATTERN:
            here.append(_of(value[-1]))
        elif op is C.BRANCH:
            each = [_of(x) for x in value[1]]
            here.append(sorted({y for x in each for y in x}) if all(each) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            here.append(_of(value[2]))
        for x in here:
            if _worth(x) > _worth(best):
                best = x
    return best


def held(text: Column, literals: list[str]) -> Column:
    out = F.contains(text, F.lit(literals[0]))
    for x in literals[1:]:
        out = out | F.contains(text, F.lit(x))
    return out


def matches(text: Column, flags: str, pattern: str) -> Column:
    """``text`` matches ``flags`` + ``pattern``, which do not ignore case; tried where it can."""
    literals = needed(pattern)
    test = text.rlike(flags + pattern)
    return test if literals is None else held(text, literals) & test
