"""Required literals of patterns, and one automaton over the literals of many patterns.

A pattern can only match where one of its required literals stands, so a text is read once by the automaton and each line then meets
only the few patterns whose literal it holds.  A pattern without a required literal meets every line.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from scanloom.functions.text import LINE_BREAK

try:  # a C automaton; without it, literals are searched one by one
    import ahocorasick
except ImportError:
    ahocorasick = None

_parser = re._parser
_BREAK = re.compile(LINE_BREAK)
_FLAGS = re.compile(r"(?:\(\?[a-zA-Z-]+\))*")
_CLASS = re.compile(r"\\(?:([pP])(?:\{\w+(?:=\w+)?\}|[A-Z])|.)", re.S)
_ESCAPE = re.compile(r"\\.", re.S)
# Characters of a class that are worth listing as literals of their own.
FEW = 8


def fold_char(ch: str) -> str:
    """The one character under which case-insensitive Unicode matching files ``ch``."""
    up = ch.upper()
    return (up if len(up) == 1 else ch).lower()[:1]


def fold(text: str) -> str:
    """Folded text of the same length."""
    if text.isascii():
        return text.lower()
    return text.translate({ord(c): fold_char(c) for c in set(text)})


def required_literals(pattern: str) -> frozenset[str] | None:
    """Folded texts of which every match of ``pattern`` holds one at least; None when there are none or it is not understood."""
    try:
        return _of(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError, AttributeError):
        return None


def java_literals(pattern: str) -> frozenset[str] | None:
    """:func:`required_literals` of a pattern as the JVM reads it: with leading flags, and ``\\p`` classes, which list no literals.

    Free spacing and classes within classes are read in other ways there, so they count as not understood.
    """
    flags = _FLAGS.match(pattern).group()
    body = _CLASS.sub(lambda m: m.group() if m.group(1) is None else r"\w", pattern[len(flags):])
    bare = _ESCAPE.sub("", body)
    if "x" in flags or "&&" in bare or re.search(r"\[[^\]]*\[", bare):
        return None
    return required_literals(body)


def _of(items) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += fold_char(chr(arg))
            continue
        if name == "AT":  # an anchor or a word border takes no room
            continue
        found.append(frozenset([run]))
        run = ""
        if name == "SUBPATTERN":
            found.append(_of(arg[3]) or frozenset([""]))
        elif name in ("ATOMIC_GROUP",):
            found.append(_of(arg) or frozenset([""]))
        elif name == "BRANCH":
            found.append(frozenset().union(*[_of(b) or frozenset([""]) for b in arg[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found.append(_of(arg[2]) or frozenset([""]))
        elif name == "IN" and len(arg) <= FEW and all(str(o) == "LITERAL" for o, _ in arg):
            found.append(frozenset(fold_char(chr(c)) for _, c in arg))
    found.append(frozenset([run]))
    best = max(found, key=lambda s: (min(map(len, s)), -len(s)))
    return best if min(map(len, best)) else None


class LineMatcher:
    """Lines of a text with the numbers of the patterns that may match there."""

    def __init__(self, patterns: list[str]):
        owners: dict[str, list[int]] = {}
        self.always: list[int] = []
        for number, pattern in enumerate(patterns):
            literals = java_literals(pattern)
            for literal in literals or ():
                owners.setdefault(literal, []).append(number)
            if literals is None:
                self.always.append(number)
        self.owners = owners
        self.automaton = None
        if ahocorasick and owners:
            self.automaton = ahocorasick.Automaton()
            for literal in owners:
                self.automaton.add_word(literal, literal)
            self.automaton.make_automaton()

    def _places(self, text: str):
        """(place in the text, literal) of every occurrence."""
        folded = fold(text)
        if self.automaton is not None:
            for end, literal in self.automaton.iter(folded):
                yield end, literal
            return
        for literal in self.owners:
            at = folded.find(literal)
            while at >= 0:
                yield at + len(literal) - 1, literal
                at = folded.find(literal, at + 1)

    def candidates(self, text: str) -> list[tuple[int, str, int]]:
        """(line number from 1, line, pattern number), in this order; nothing for lines that hold no literal."""
        return [(line, at, number) for line, at, numbers in self.lines(text) for number in numbers]

    def lines(self, text: str) -> list[tuple[int, str, list[int]]]:
        """(line number from 1, line, pattern numbers) of each line with a candidate."""
        hits: dict[int, set[int]] = {}
        starts, ends = [0], []
        seen: set[tuple[int, str]] = set()
        places = list(self._places(text)) if self.owners else []
        if not places and not self.always:
            return []
        for m in _BREAK.finditer(text):
            ends.append(m.start())
            starts.append(m.end())
        ends.append(len(text))
        if starts[-1] == len(text):  # an empty last piece is no line
            starts.pop(), ends.pop()
        for place, literal in places:
            line = bisect_right(starts, place) - 1
            if (line, literal) not in seen:
                seen.add((line, literal))
                hits.setdefault(line, set()).update(self.owners[literal])
        if self.always:
            for line in range(len(starts)):
                hits.setdefault(line, set()).update(self.always)
        return [(line + 1, text[starts[line]:ends[line]], sorted(hits[line])) for line in sorted(hits)]
