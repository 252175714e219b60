"""Boolean trigram queries that follow from a regular expression.

``clauses(pattern)`` gives a list of trigram sets: any text that matches holds all
trigrams of one of them at least. An empty list says that no trigram is
mandatory, so that the rule has to scan everything. Letters are lower-cased,
and the text has to be so too.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as sre_parser

#: Sets of strings beyond this size are cut off and treated as unknown text.
MAX_STRINGS = 64


def _strings(tree) -> list[set[str] | None]:
    """One entry per element: the strings that it can be, or None if there are too many."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            out.append(chars if chars and len(chars) <= 8 else None)
        elif op is sre.SUBPATTERN:
            out.extend(_strings(arg[-1]))
        elif op is sre.BRANCH:
            found: set[str] | None = set()
            for branch in arg[1]:
                whole = _product(_strings(branch))
                found = None if whole is None or found is None else found | whole
            out.append(found)
        elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            once = _product(_strings(arg[2]))
            out.append(None if once is None else once | {""})
        elif op is sre.MAX_REPEAT and arg[0] == arg[1]:
            out.extend(_strings(arg[2]) * int(arg[0]))
        else:
            out.append(None)
    return out


def _product(parts: list[set[str] | None]) -> set[str] | None:
    strings = {""}
    for part in parts:
        if part is None or len(strings) * len(part) > MAX_STRINGS:
            return None
        strings = {a + b for a in strings for b in part}
    return strings


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def clauses(pattern: str) -> list[frozenset[str]]:
    runs: list[set[str]] = [{""}]
    for part in _strings(sre_parser.parse(pattern)):
        if part is None:
            runs.append({""})
        elif (joined := _product([runs[-1], part])) is None:
            runs.append(part)
        else:
            runs[-1] = joined
    # A conjunction of runs, each of them a choice of strings; the smallest choice of those with trigrams throughout.
    usable = [{_grams(s) for s in run} for run in runs if all(len(s) >= 3 for s in run)]
    if not usable:
        return []
    singles = frozenset().union(*(next(iter(u)) for u in usable if len(u) == 1))
    choice = min((u for u in usable if len(u) > 1), key=len, default={frozenset()})
    found = {singles | c for c in choice}
    return sorted((c for c in found if not any(other < c for other in found)), key=sorted)
