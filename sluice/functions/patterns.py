"""What a pattern cannot match without: literals that are looked for before the regular expression is run."""

from __future__ import annotations

import re
import warnings
from functools import lru_cache
from re import _parser as parser

LEAST, MOST = 3, 8  # characters of a literal worth looking for, alternatives


@lru_cache(maxsize=100_000)
def required(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which each match of the (Java) pattern holds one, in any case; none if there is nothing to be sure of.

    The syntax tree is that of Python, whose literals, alternatives and repetitions mean the same; what it cannot parse, or what is not ASCII, is not told.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(pattern.replace("(?i)", ""))
    except (ValueError, RecursionError, OverflowError, Warning, parser.error):
        return ()
    found = _best(tree)
    return tuple(sorted(found)) if found else ()


_WRAPPED = re.compile(r"\(((?:[^()\[\]\\|]|\[[^\[\]\\&^](?:[^\[\]\\&]|\\[wdsWDS.])*\]|\[\\[wdsWDS.](?:[^\[\]\\&]|\\[wdsWDS.])*\]|\\[wdsWDS.]|\(\?i\))*)\)")
_AHEAD = re.compile(r"((?:\(\?i\))?)\.\*(?![*+?{])(.*)", re.S)
_RUN = re.compile(r"((?:\(\?i\))?)(\[[^\[\]&^]+\]|\\[wds])\+(?![*+?{])(.*)", re.S)


@lru_cache(maxsize=100_000)
def searched(pattern: str) -> str:
    """A pattern that is found in the same texts as ``pattern``: without the ``.*`` at its ends, and with one character for a run that it begins with.

    A search tries every place, where a leading ``.*`` or run reads on to the end of the line or run: in long lines that is quadratic, and changes nothing about
    whether there is a match. Only patterns in one group, without alternatives, inner groups or anchors, are changed; any other is left as it is.
    """
    whole = _WRAPPED.fullmatch(pattern)
    if not whole or "^" in pattern or "$" in pattern:
        return pattern
    inner = whole.group(1)
    while m := _AHEAD.fullmatch(inner):
        inner = m.group(1) + m.group(2)
    while inner.endswith(".*") and not inner.endswith("\\.*"):
        inner = inner[:-2]
    if m := _RUN.fullmatch(inner):
        inner = "".join(m.groups())
    return f"({inner})"


def _usable(alternatives: set[str]) -> bool:
    return 0 < len(alternatives) <= MOST and all(len(x) >= LEAST and x.isascii() for x in alternatives)


def _better(a: set[str], b: set[str]) -> set[str]:
    """The set whose shortest literal is longer."""
    usable = [x for x in (a, b) if _usable(x)]
    return max(usable, key=lambda x: (min(map(len, x)), -len(x)), default=set())


def _best(nodes) -> set[str]:
    best: set[str] = set()
    run = ""
    for op, value in [*nodes, (None, None)]:
        if op is parser.LITERAL:
            run += chr(value).lower()
            continue
        best, run = _better(best, {run}), ""
        if op is parser.SUBPATTERN:
            best = _better(best, _best(value[3]))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
            best = _better(best, _best(value[2]))
        elif op is parser.BRANCH:
            parts = [_best(x) for x in value[1]]
            if all(parts):
                best = _better(best, set().union(*parts))
    return best
