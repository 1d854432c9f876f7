"""What a text must contain for a rule to match: literals out of patterns, and one automaton over those of all rules."""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser as parser

import ahocorasick

#: A set of literals larger than this tells too little to be worth its search.
MOST = 200
#: Strings that a run of letters, sets and groups is written out to at most.
_WRITTEN = 48
#: Letters that equal another without regard to case, though they are not its lower case.
_FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i"})


def folded(text: str) -> str:
    """Lower case as a search that ignores case sees it."""
    return text.translate(_FOLDED).lower()


def _characters(items: list) -> frozenset[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            out.add(chr(value))
        elif op is ops.RANGE and value[1] - value[0] < 16:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        elif op is ops.CATEGORY and value is ops.CATEGORY_DIGIT:
            out |= set("0123456789")
        else:
            return None
    return frozenset(map(folded, out))


def _weight(literal: str) -> float:
    """How much finding a literal tells: white space nothing, a letter or sign little, more the longer it is."""
    return sum(0 if c.isspace() else 1.2 if c.isdigit() else 1 for c in literal)


def _better(one: frozenset[str] | None, two: frozenset[str] | None) -> frozenset[str] | None:
    """The set that tells more: literals of more weight, then fewer."""
    sets = [s for s in (one, two) if s and len(s) <= MOST and all(map(_weight, s))]
    return max(sets, key=lambda s: (min(map(_weight, s)), -len(s)), default=None)


def _written(op, value) -> frozenset[str] | None:
    """All strings that an item matches, where these are few; what has no width matches the empty one."""
    if op is ops.LITERAL:
        return frozenset([folded(chr(value))])
    if op is ops.AT:
        return frozenset([""])
    if op is ops.IN:
        return _characters(value)
    if op is ops.SUBPATTERN:
        return _all([frozenset([""]), *(_written(*item) for item in value[3])])
    if op is ops.BRANCH:
        parts = [_all([frozenset([""]), *(_written(*item) for item in part)]) for part in value[1]]
        return None if None in parts else frozenset().union(*parts)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[:2] == (0, 1):
        once = _all([frozenset([""]), *(_written(*item) for item in value[2])])
        return None if once is None else once | {""}
    return None


def _all(parts: list[frozenset[str] | None]) -> frozenset[str] | None:
    """The parts' strings one after the other; None where a part is open or they become too many."""
    out = frozenset([""])
    for part in parts:
        if part is None or len(out) * len(part) > _WRITTEN:
            return None
        out = frozenset(a + b for a in out for b in part)
    return out


def _of(items) -> frozenset[str] | None:
    """Literals one of which every match holds; None where there is no such set."""
    nothing = frozenset([""])
    best, run = None, nothing
    for op, value in items:
        # Sets and groups go on with letters before them; at a beginning they may be searched for as they are.
        longer = _all([run, _written(op, value)]) if op in (ops.LITERAL, ops.AT) or run != nothing else None
        if longer is not None:
            run = longer
            continue
        best, run = _better(best, run), nothing
        if op is ops.LITERAL:
            run = _written(op, value)
            continue
        if op is ops.SUBPATTERN:
            found = _of(value[3])
        elif op is ops.BRANCH:
            parts = [_of(p) for p in value[1]]
            found = None if None in parts else frozenset().union(*parts)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            found = _of(value[2]) if value[0] else None
        elif op is ops.IN:
            found = _characters(value)
        elif op is ops.ASSERT:
            found = _of(value[1])
        else:
            found = None
        best = _better(best, found)
    return _better(best, run)


def required(pattern: str) -> frozenset[str] | None:
    """Literals in lower case, one of which occurs in every text that the pattern matches; None where none is known."""
    # Properties of characters tell no literal: a letter stands for them.
    plain = re.sub(r"\\p\{[^}]*\}", r"\\w", pattern)
    try:
        return _of(parser.parse(plain))
    except (re.error, OverflowError, RecursionError):
        return None


class Prefilter:
    """Which of many (pattern or phrases) a text can match, by one pass over it."""

    def __init__(self, searches: list[tuple[str, tuple[str, ...]]]):
        self.always: list[int] = []
        held: dict[str, set[int]] = {}
        for i, (pattern, phrases) in enumerate(searches):
            literals = frozenset(map(folded, phrases)) if phrases else required(pattern)
            if literals is None:
                self.always.append(i)
            for literal in literals or ():
                held.setdefault(literal, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for literal, rules in held.items():
            self.automaton.add_word(literal, frozenset(rules))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def __call__(self, text: str) -> list[int]:
        found = set(self.always)
        if not self.empty:
            for _, rules in self.automaton.iter(folded(text)):
                found |= rules
        return sorted(found)


# Fixed value: strings, templates and comments of scripts.
_LITERALS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`")
_HOLES = re.compile(r"(\$\{[^{}]*\})")


def without_literals(text: str) -> str:
    """A script with spaces over its comments and inside its strings; what templates compute stays."""

    def blank(match: re.Match) -> str:
        found = match[0]
        if found[0] == "/":
            return " " * len(found)
        inner = found[1:-1]
        parts = _HOLES.split(inner) if found[0] == "`" else [inner]
        return found[0] + "".join(p if i % 2 else " " * len(p) for i, p in enumerate(parts)) + found[-1]

    return _LITERALS.sub(blank, text)
