"""Language identification by interpolated Kneser-Ney character models, one per language.

A character is its 16-bit code after lower-casing, everything but letters being one space, so an n-gram of up to four characters is
a 64-bit integer and the models are sorted integer arrays: for each order all n-grams of any language, with a row of one
log-probability per language, and all contexts with a row of back-off weights.  A text's cross-entropy under every language comes
from one search per character in the highest order and further ones only for n-grams that no language has.

The language with the lowest cross-entropy per character is chosen.  It is rejected if its cross-entropy exceeds what nearly all
texts of the language stay below; the score is a softmax whose sharpness is fitted on texts kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.tables import ship_package
from scanloom.llm.words import chunks, lookup

ORDER = 4
_SPACE = 32
_LETTER = np.zeros(0, bool)


@dataclass(frozen=True)
class Sample:
    """Bound of the fitted sample: rows of each language, chosen by hash of the id among texts of at most ``chars`` characters."""
    rows: int = 400
    chars: int = 20_000


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)        # by order - 1
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))  # highest accepted cross-entropy by language
    sharpness: float = 1.0


def codes(text: str | None) -> np.ndarray:
    """16-bit codes of the lower-cased letters, runs of other characters as one space; empty if there is no letter."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    if not text:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[c]
    c = np.where(letter, np.minimum(c, 0xFFFF), _SPACE)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    if not letter.any():
        return np.zeros(0, np.uint64)
    return c[kept].astype(np.uint64)


def _grams(c: np.ndarray) -> np.ndarray:
    """For each character the 64-bit integer of it and the three before it, spaces before the start."""
    p = np.concatenate([np.full(ORDER - 1, _SPACE, np.uint64), c])
    out = np.zeros(len(c), np.uint64)
    for j in range(ORDER):
        out = (out << np.uint64(16)) | p[j:j + len(c)]
    return out


def _tail(key: np.ndarray, order: int) -> np.ndarray:
    return key & np.uint64((1 << (16 * order)) - 1) if order < 4 else key


class _KneserNey:
    """Counts of one language; ``count[n]``, ``total[n]`` and ``types[n]`` by n-gram and context of order n."""

    def __init__(self, grams: np.ndarray, symbols: int):
        self.symbols = symbols
        self.key, self.count, self.ctx, self.total, self.types, self.cut = {}, {}, {}, {}, {}, {}
        key, count = np.unique(grams, return_counts=True)
        for n in range(ORDER, 0, -1):
            self.key[n], self.count[n] = key, count
            self.ctx[n], at = np.unique(key >> np.uint64(16), return_inverse=True)
            self.total[n], self.types[n] = np.bincount(at, count), np.bincount(at)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            self.cut[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
            # Of a lower order only the number of different characters before it counts.
            key, count = np.unique(_tail(key, n - 1), return_counts=True) if n > 1 else (key, count)

    def backoff(self, n: int, ctx: np.ndarray) -> np.ndarray:
        at, ok = lookup(self.ctx[n], ctx)
        return np.where(ok, self.cut[n] * self.types[n][at] / self.total[n][at], 1.0)

    def prob(self, n: int, key: np.ndarray) -> np.ndarray:
        if n == 0:
            return np.full(len(key), 1 / self.symbols)
        ctx = key >> np.uint64(16) if n > 1 else np.zeros(len(key), np.uint64)
        at, ok = lookup(self.key[n], key)
        here, seen = lookup(self.ctx[n], ctx)
        own = np.where(ok & seen, np.maximum(self.count[n][at] - self.cut[n], 0) / self.total[n][here], 0.0)
        return own + self.backoff(n, ctx) * self.prob(n - 1, _tail(key, n - 1))


def train(texts: dict[str, list[str]]) -> Model:
    """Models of the languages given with their texts; a language without any letter is not learned."""
    grams = {lang: np.concatenate([_grams(codes(t)) for t in own] or [np.zeros(0, np.uint64)]) for lang, own in sorted(texts.items())}
    grams = {lang: g for lang, g in grams.items() if len(g)}
    if not grams:
        return Model()
    symbols = len(np.unique(np.concatenate([_tail(g, 1) for g in grams.values()]))) + 1
    models = [_KneserNey(g, symbols) for g in grams.values()]
    out = Model(langs=list(grams))
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([m.key[n] for m in models]))
        ctx = np.unique(np.concatenate([m.ctx[n] for m in models]))
        out.keys.append(keys)
        out.contexts.append(ctx)
        out.logp.append(np.log2(np.stack([m.prob(n, keys) for m in models], axis=1)).astype(np.float32))
        out.backoff.append(np.log2(np.stack([m.backoff(n, ctx) for m in models], axis=1)).astype(np.float32))
    out.unseen = np.log2(np.array([m.backoff(1, np.zeros(1, np.uint64))[0] / symbols for m in models])).astype(np.float32)
    out.limit = np.full(len(models), np.inf)
    return out


def cross_entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bits per character of each text under each language, characters of each text)."""
    bits, size = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    texts = [t or "" for t in texts]
    for at, part in chunks(texts, 1 << 19):
        own = [codes(t) for t in part]
        n = np.array([len(c) for c in own])
        size[at:at + len(part)] = n
        if not n.sum() or not model.langs:
            continue
        gram = np.concatenate([_grams(c) for c in own])
        logp = np.zeros((len(gram), len(model.langs)), np.float32)
        rest = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            key = _tail(gram[rest], order)
            place, ok = lookup(model.keys[order - 1], key)
            logp[rest[ok]] += model.logp[order - 1][place[ok]]
            rest, key = rest[~ok], key[~ok]
            if order > 1 and len(rest):
                place, ok = lookup(model.contexts[order - 1], key >> np.uint64(16))
                logp[rest[ok]] += model.backoff[order - 1][place[ok]]
        logp[rest] += model.unseen
        full = np.flatnonzero(n)
        start = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        bits[at + full] = -np.add.reduceat(logp, start, axis=0, dtype=np.float64) / n[full, None]
    return bits, size


def _softmax_best(bits: np.ndarray, sharpness: float) -> np.ndarray:
    return 1 / np.exp(-sharpness * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)


def calibrate(model: Model, texts: list[str], langs: list[str], quantile: float = 0.995, slack: float = 0.25) -> None:
    """Fit the rejection limit of each language and the softmax on texts that were not trained on."""
    bits, size = cross_entropies(model, texts)
    index = {lang: i for i, lang in enumerate(model.langs)}
    y = np.array([index.get(lang, -1) for lang in langs])
    ok = (size > 0) & (y >= 0)
    bits, y = bits[ok], y[ok]
    for i in range(len(model.langs)):
        own = bits[y == i, i]
        if len(own):
            model.limit[i] = np.quantile(own, quantile) + slack
    if len(y):
        rows = np.arange(len(y))
        def loss(s: float) -> float:
            z = -s * (bits - bits.min(axis=1, keepdims=True))
            return float((np.log(np.exp(z).sum(axis=1)) - z[rows, y]).mean())
        model.sharpness = min((0.5 * 1.5 ** k for k in range(12)), key=loss)


def fit(docs: DataFrame, learn: Column | None = None, sample: Sample = Sample(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of every non-null language of the rows that meet ``learn``, a condition on the id; one row in five calibrates.

    Only text and language are used.  A language's rows are those with the lowest hashes of their ids; a bound on the hash from the
    language's count lets about four times as many through to the ranking, at any size of the table (fewer where ids repeat).
    No such row: a model without languages, under which every text is ``und``.
    """
    ship_package(docs.sparkSession)
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= sample.chars))
    usable = usable if learn is None else usable.filter(learn)
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    often = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    hashed = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h")).join(F.broadcast(often), "lang")
    low = (F.col("h").cast("double") + 2.0**63) / 2.0**64 * F.col("n") <= 4 * sample.rows + 200
    picked = hashed.filter(low).select("id", "lang", "h").distinct().withColumn("r", order).filter(F.col("r") <= sample.rows)
    # The ids are at most ``rows`` a language.
    rows = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(picked.select("id", "lang", "r")), ["id", "lang"]).toPandas()
    rows = rows.sort_values(["lang", "r", "text"], kind="stable")
    held = rows.r % 5 == 4
    model = train({lang: part.text.tolist() for lang, part in rows[~held].groupby("lang")})
    if held.any():
        calibrate(model, rows[held].text.tolist(), rows[held].lang.tolist())
    return model


def identify(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score, cross_entropy, accepted) of each whole text.

    ``lang_pred`` is a learned language, or ``und`` for null and for texts without a letter (score 0, no cross-entropy, not
    accepted).  Ties go to the language that sorts first.  ``accepted`` is the calibrated rejection: false if even the best
    language fits worse than nearly all of its own texts.
    """
    @F.pandas_udf("lang_pred string, score double, cross_entropy double, accepted boolean")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            bits, size = cross_entropies(model, texts.tolist())
            if not model.langs:
                size = size * 0
                bits = np.zeros((len(texts), 1))
            best = bits.argmin(axis=1)
            low, some = bits[np.arange(len(best)), best], size > 0
            langs = np.array([*model.langs, "und"], object)
            limit = np.append(model.limit, -np.inf)
            yield pd.DataFrame({"lang_pred": langs[np.where(some, best, len(model.langs))], "score": np.where(some, _softmax_best(bits, model.sharpness), 0.0),
                                "cross_entropy": np.where(some, low, np.nan), "accepted": some & (low <= limit[best])})

    return named(text)
