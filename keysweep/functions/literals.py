"""Literals that every match of a regex must contain, from the regex's syntax tree.

A rule's regex need not see a line that lacks them, and looking for a literal runs at memory speed.  ``required`` returns
clauses: each is a set of strings of which every match contains at least one.  They come out of one walk over the tree: a part
that can only match a few strings keeps them (``exact``), neighbours of such parts are multiplied out, and what surrounds a part
of any other kind becomes a clause.  An expression that the walk doesn't understand has no clauses, and its rule is not gated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from itertools import product

try:  # the standard library's own parser of expressions
    from re import _constants as K
    from re import _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as K
    import sre_parse as P

#: Strings that a part may stand for before it is treated as unknown, and characters of a class that are told apart.
MOST_STRINGS, MOST_IN_CLASS = 24, 8
#: Strings that a rule's own gate looks for rather than more; and how long what several strings have in common must be to be
#: looked for instead of them, by one rule and by all.
FEW, LONG_ENOUGH, LONG_FOR_ALL = 3, 3, 5
#: About how likely a given character stands at a given place.
CHANCE = 0.05
#: What Java reads in another way than Python, or only Java reads.
FOREIGN = re.compile(r"\\[vhHRNGzQpP]|&&|\[[^\]\\]*\[|\\x\{")


@dataclass
class _Part:
    """What a part of an expression matches: only the strings of ``exact``, if known; and the clauses that hold anyway."""

    exact: frozenset[str] | None
    clauses: list[frozenset[str]] = field(default_factory=list)


UNKNOWN = _Part(None)
EMPTY = _Part(frozenset({""}))


@dataclass(frozen=True)
class Required:
    """``lowered``: to be looked for in the lower-cased text; clauses by rising chance to be met without a match."""

    lowered: bool
    clauses: tuple[tuple[str, ...], ...]


def chance(clause) -> float:
    """Roughly how often a place holds one of the strings by accident."""
    return sum(CHANCE ** len(s) for s in clause)


def minimal(strings) -> frozenset[str]:
    """Without the strings that hold another one."""
    strings = set(strings)
    return frozenset(a for a in strings if not any(b != a and b in a for b in strings))


def in_common(strings) -> str:
    """A longest string that all of them hold."""
    first, *rest = sorted(strings, key=lambda s: (len(s), s))
    for n in range(len(first), 0, -1):
        for k in range(len(first) - n + 1):
            if all(first[k:k + n] in s for s in rest):
                return first[k:k + n]
    return ""


def _clause(strings: frozenset[str]) -> list[frozenset[str]]:
    """What finding one of the strings amounts to; nothing if one of them is empty."""
    if not strings or "" in strings:
        return []
    found = [minimal(strings)]
    if len(found[0]) > 1 and len(common := in_common(found[0])) >= LONG_ENOUGH:
        found.append(frozenset({common}))
    return found


def _concatenation(parts: list[_Part]) -> _Part:
    clauses: list[frozenset[str]] = []
    now, whole = frozenset({""}), True
    for part in parts:
        both = None if part.exact is None else frozenset(a + b for a, b in product(now, part.exact))
        if both is not None and len(both) <= MOST_STRINGS:
            now = both
            continue
        clauses += _clause(now)
        whole = False
        now = part.exact if part.exact is not None else frozenset({""})
        if part.exact is None:
            clauses += part.clauses
    if whole:
        return _Part(now)
    return _Part(None, clauses + _clause(now))


def _alternation(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        together = frozenset().union(*(p.exact for p in parts))
        if len(together) <= MOST_STRINGS:
            return _Part(together)
    best = []
    for part in parts:
        clauses = part.clauses if part.exact is None else _clause(part.exact)
        if not clauses:
            return UNKNOWN
        best.append(min(clauses, key=chance))
    return _Part(None, _clause(frozenset().union(*best)))


def _repeated(part: _Part, least: int, most: int) -> _Part:
    if part.exact is not None and least == most:
        return _concatenation([part] * least) if least <= MOST_STRINGS else _concatenation([part] * MOST_STRINGS + [UNKNOWN])
    if part.exact is not None and (least, most) == (0, 1):
        return _Part(part.exact | {""})
    if least == 0:
        return UNKNOWN
    return _concatenation([part] * min(least, MOST_STRINGS) + [UNKNOWN]) if part.exact is not None else _Part(None, part.clauses)


def _class(items, fold) -> _Part:
    chars: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            chars.add(fold(chr(value)))
        elif op is K.RANGE and value[1] - value[0] < MOST_IN_CLASS:
            chars.update(fold(chr(c)) for c in range(value[0], value[1] + 1))
        else:
            return UNKNOWN
    return _Part(frozenset(chars)) if None not in chars and len(chars) <= MOST_IN_CLASS else UNKNOWN


def _walk(tree, fold) -> _Part:
    parts = []
    for op, value in tree:
        if op is K.LITERAL:
            char = fold(chr(value))
            parts.append(UNKNOWN if char is None else _Part(frozenset({char})))
        elif op is K.IN:
            parts.append(_class(value, fold))
        elif op is K.BRANCH:
            parts.append(_alternation([_walk(x, fold) for x in value[1]]))
        elif op is K.SUBPATTERN:
            parts.append(_walk(value[3], fold))
        elif op is K.ATOMIC_GROUP:
            parts.append(_walk(value, fold))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            most = None if value[1] is K.MAXREPEAT else int(value[1])
            parts.append(_repeated(_walk(value[2], fold), int(value[0]), most))
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            parts.append(EMPTY)
        else:
            parts.append(UNKNOWN)
    return _concatenation(parts)


def _any_case(tree) -> bool:
    """Whether some group of the expression ignores case."""
    for op, value in tree:
        inner = []
        if op is K.SUBPATTERN:
            if value[1] & re.IGNORECASE:
                return True
            inner = [value[3]]
        elif op is K.BRANCH:
            inner = value[1]
        elif op is K.ATOMIC_GROUP:
            inner = [value]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            inner = [value[2]]
        if any(_any_case(x) for x in inner):
            return True
    return False


@cache
def required(pattern: str) -> Required:
    """The clauses of ``pattern``, best first; none if it can't be told what its matches contain."""
    if FOREIGN.search(pattern):
        return Required(False, ())
    try:
        tree = P.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except (re.error, OverflowError, RecursionError):
        return Required(False, ())
    lowered = bool(tree.state.flags & re.IGNORECASE) or _any_case(tree)
    # In lower-cased text only letters of ASCII are known to stand for what the engine lets them stand for.
    fold = (lambda c: c.lower() if ord(c) < 128 else None) if lowered else (lambda c: c)
    whole = _walk(tree, fold)
    clauses = _clause(whole.exact) if whole.exact is not None else whole.clauses
    ranked = sorted({c for c in clauses if "" not in c}, key=lambda c: (chance(c) * (1 + 0.01 * len(c)), sorted(c)))
    return Required(lowered, tuple(tuple(sorted(c)) for c in ranked))


def gate(pattern: str) -> Required:
    """At most two clauses for a rule's own gate: the best one (of few strings, if that is rare enough), and another one if it
    asks for something else."""
    found = required(pattern)
    if not found.clauses:
        return found
    best = next((c for c in found.clauses if len(c) <= FEW and chance(c) < CHANCE ** LONG_ENOUGH), found.clauses[0])
    more = [c for c in found.clauses if c != best and not all(any(s in b for s in c) for b in best)
            and not all(any(b in s for b in best) for s in c)]
    return Required(found.lowered, (best, *more[:1]))


def prefilter(patterns: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(literals, lower-case literals, patterns without any): a text in which one of the patterns matches holds one of the
    literals, or one of the lower-case ones when lower-cased, or is matched by one of the last.

    For each pattern the clause is taken that adds the fewest literals to those that others need anyway."""
    raw: set[str] = set()
    low: set[str] = set()
    open_ended = [p for p in patterns if not required(p).clauses]
    found = sorted((required(p) for p in patterns if required(p).clauses), key=lambda r: (not r.lowered, len(r.clauses), chance(r.clauses[0])))

    def missing(r: Required, clause) -> list[str]:
        return [s for s in clause if not any(x in s.lower() for x in low) and (r.lowered or not any(x in s for x in raw))]

    for r in found:
        likely = [c for c in r.clauses if chance(c) <= max(chance(r.clauses[0]), CHANCE ** LONG_ENOUGH)]
        best = min(likely, key=lambda c: (len(missing(r, c)), chance(c)))
        (low if r.lowered else raw).update(missing(r, best))
    low = _merged(low)
    return sorted(_merged(s for s in raw if not any(x in s.lower() for x in low))), sorted(low), open_ended


def _merged(strings) -> set[str]:
    """Strings with a long part in common are looked for by that part."""
    left = sorted(minimal(strings))
    while True:
        pairs = [(len(c), c, a, b) for k, a in enumerate(left) for b in left[k + 1:] if len(c := in_common((a, b))) >= max(LONG_FOR_ALL, len(a) / 2, len(b) / 2)]
        if not pairs:
            return set(left)
        _, common, a, b = max(pairs)
        left = sorted(minimal({*left, common} - {a, b}))
