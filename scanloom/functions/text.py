"""Text helpers: line splitting, normalising, entropy, sequence similarity.

Only the two sequence-matcher ratios need Python (Arrow-batched pandas UDFs over the standard
library); everything around them is native, and the native length bound keeps hopeless pairs
away from Python.
"""

from __future__ import annotations

import difflib
import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every line boundary that universal line splitting knows.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
# Unicode white space, as in whitespace splitting.
SPACES = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"

# Characters with the Unicode property of white space, as one text.
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _without_last_empty(pieces: Column) -> Column:
    n = F.size(pieces)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), n - 1)).otherwise(pieces)


def split_lines(text: Column) -> Column:
    """All lines of a text; every kind of line break counts and a final empty piece is dropped."""
    return _without_last_empty(F.split(text, LINE_BREAK, -1))


def newline_lines(text: Column) -> Column:
    """Lines broken at newlines only, as a text reader yields them (CRLF and CR become newline)."""
    return _without_last_empty(F.split(text, r"\r\n|\n|\r", -1))


def collapse_spaces(text: Column) -> Column:
    """Lower case, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, " "))


def shannon_entropy(text: Column) -> Column:
    """Bits per character: -sum p*log2(p) over the distinct characters."""
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))

    def add(acc: Column, ch: Column) -> Column:
        p = (n - F.length(F.replace(text, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), add)).otherwise(F.lit(0.0))


def ratio_bound(a: Column, b: Column) -> Column:
    """Largest ratio two texts of these lengths can reach: 2*min/(sum)."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


# Ratios a Python worker has computed, by digest of both texts, so that no text is kept: some 20 MB when full.
_RATIOS: dict[bytes, float] = {}
_MOST_RATIOS = 200_000


def sequence_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio with the standard defaults; not symmetric, ``a`` is the leader."""
    digest = hashlib.blake2b(a.encode("utf-8", "surrogatepass"), digest_size=16)
    digest.update(b"\xff" + b.encode("utf-8", "surrogatepass"))
    key = digest.digest()
    if key not in _RATIOS:
        if len(_RATIOS) >= _MOST_RATIOS:
            _RATIOS.clear()
        _RATIOS[key] = difflib.SequenceMatcher(None, a, b).ratio()
    return _RATIOS[key]


def reaches(a: str, b: str, bound: float) -> bool:
    """Can the ratio be >= bound?  Cheap upper bounds only; never says no wrongly."""
    total = len(a) + len(b)
    if total == 0:
        return True
    if 2.0 * min(len(a), len(b)) / total < bound:
        return False
    if total <= 400:
        return True
    shared = sum((Counter(a) & Counter(b)).values())
    return 2.0 * shared / total >= bound


class GramIndex:
    """Inverted index of the characters and character pairs of some texts: which of them may reach a ratio to a text.

    A ratio of t over texts of T characters together needs M >= t * T / 2 matched characters.  They stand in both texts, and since
    two matched runs are parted by an unmatched character, in at most T - 2 * M + 1 runs: so at least M common characters and
    3 * M - T - 1 common pairs, each counted as often as it occurs.  Both counts come from the posting lists of the text's own grams.
    """

    def __init__(self, texts: list[str]):
        self.length = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        number = np.repeat(np.arange(len(texts)), self.length)
        same = number[1:] == number[:-1]
        self.lists = [self._posted(chars, number), self._posted((chars[:-1] << 21 | chars[1:])[same], number[1:][same])]

    @staticmethod
    def _posted(grams: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """(gram, where its list begins, text numbers, counts), lists in the order of the grams."""
        order = np.lexsort((number, grams))
        grams, number = grams[order], number[order]
        first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (number[1:] != number[:-1])])) if len(grams) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(grams)))
        kinds, begin = np.unique(grams[first], return_index=True)
        return kinds, np.append(begin, len(first)), number[first], count

    def _common(self, posted: tuple[np.ndarray, ...], grams: np.ndarray) -> np.ndarray:
        kinds, begin, number, count = posted
        own, times = np.unique(grams, return_counts=True)
        at = np.searchsorted(kinds, own)
        found = at < len(kinds)
        found[found] = kinds[at[found]] == own[found]
        at, times = at[found], times[found]
        size = begin[at + 1] - begin[at]
        if not size.sum():
            return np.zeros(len(self.length), np.int64)
        take = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        shared = np.minimum(count[take], np.repeat(times, size))
        return np.bincount(number[take], shared, len(self.length)).astype(np.int64)

    def may_reach(self, text: str, bound: float) -> np.ndarray:
        """For each text whether the ratio may be >= ``bound``; never false wrongly."""
        total = self.length + len(text)
        matched = bound * total / 2 - 1e-9
        near = np.minimum(self.length, len(text)) >= matched
        if near.any():
            chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            near &= self._common(self.lists[0], chars) >= matched
            near &= self._common(self.lists[1], chars[:-1] << 21 | chars[1:]) >= 3 * matched - total - 1
        return near


@F.pandas_udf(T.DoubleType())
def text_similarity(leader: pd.Series, other: pd.Series) -> pd.Series:
    """Ratio of the lower-cased texts."""
    return pd.Series([sequence_ratio((a or "").lower(), (b or "").lower()) for a, b in zip(leader, other)])


@F.pandas_udf(T.DoubleType())
def _collapsed_ratio(leader: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(a, b) if a and b else 0.0 for a, b in zip(leader, other)])


def code_similarity(leader: Column, other: Column) -> Column:
    """Ratio of the texts after native normalising; 0 when either is blank."""
    return _collapsed_ratio(collapse_spaces(leader), collapse_spaces(other))
