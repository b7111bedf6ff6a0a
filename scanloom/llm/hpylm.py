"""Language-model scoring by a hierarchical Pitman-Yor model with Gibbs-sampled Chinese-restaurant seating.

A token's context is the nearest frequent word before it, or the start of the text; a word is frequent if it makes up ``1 / SHARE``
of the training tokens, so there are at most ``SHARE`` contexts at any corpus size, and each is a restaurant with a dish for every
word seen in it.  All context restaurants share one parent, whose customers are their tables and whose base is uniform over the
vocabulary and one unknown word.

Seating.  The dishes (word, context, customers) of all training tokens are counted in shards by word, so a word's customers of the
parent restaurant are counted locally.  A Gibbs sweep lifts all customers of a dish and draws their tables from the conditional, given
the other tables of the restaurant and the parent's current probability of the word; dishes with one customer need no draw.  Shards sweep side
by side with the totals of the sweep before, which are all that they share: one table count per context and two sums.  So a chain is
a function of the dish counts, the seed and those totals, and every task replays it instead of storing seatings; a lost executor
costs nothing but the replay.  Predictive probabilities are averaged over the sweeps after the burn-in.

Scoring.  Frequent words are scored where the text is read, from a table of bounded size.  All other tokens travel to their
word's shard as packed postings and come back as one sum per document and shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scanloom.llm.postings import bounds, sharded_sums, slices
from scanloom.llm.tables import batches, materialise, shards, ship_package
from scanloom.llm.words import chunks, lookup, lowered, pack, pack_small, per_text, separators, unpack, unpack_small, word_hashes

SHARE, CTX_BITS, WORD_BITS = 2000, 11, 53
EXACT, CROWDED = 512, 100
# Sums of totals that reach the driver.
PARTS = 8
END = np.uint64(0x15E9D1C3B7A215)
_TABLE = separators()
_CTX = np.uint64((1 << CTX_BITS) - 1)
_SHIFT = np.uint64(CTX_BITS)


@dataclass
class Totals:
    """What the shards share about one sweep."""
    tables: np.ndarray        # of each context restaurant
    customers: float          # of the parent restaurant
    parent_tables: float


@dataclass
class Settings:
    frequent: np.ndarray      # sorted word hashes; context i + 1 is frequent[i], 0 the start of a text
    seated: np.ndarray        # customers of each context restaurant
    vocabulary: float
    tokens: float
    discount: float
    parent_discount: float
    strength: float
    seed: int
    burn_in: int


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(53-bit word hashes with one end per text, tokens before each text and after the last)."""
    h, first = word_hashes(texts, _TABLE)
    return np.insert(h >> np.uint64(64 - WORD_BITS), first[1:], END), first + np.arange(len(first))


def contexts(word: np.ndarray, first: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of each token, place in ``frequent`` of each token or -1)."""
    at, ok = lookup(frequent, word)
    place = np.where(ok, at, -1)
    i = np.arange(len(word))
    seen = np.where(ok, i, -1)
    last = np.concatenate([[-1], np.maximum.accumulate(seen)[:-1]]) if len(i) else seen
    last[last < np.repeat(first[:-1], np.diff(first))] = -1
    return np.where(last >= 0, place[last] + 1, 0), place


@lru_cache(4)
def _log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers [c, t]: the weight of all seatings of c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(EXACT):
            join = np.log(np.maximum(0, c - discount * np.arange(1, EXACT + 1)))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], join + out[c, 1:])
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Up to a constant, for large x."""
    return (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3)


def _crowded(c: np.ndarray, a: np.ndarray, prior: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) of the tables of large dishes, by the saddle point of the seatings' generating function.

    Tables are negative binomial, their sizes independent, and the sum of the sizes is given; the radius r is where the expected
    sum is c.
    """
    low, high = np.full(len(c), -700.0), np.zeros(len(c))
    for _ in range(80):
        y = np.exp((low + high) / 2)  # 1 - r
        few = a * prior * (1 - y) * y ** (discount - 1) / (1 - prior * (1 - y**discount)) < c
        low, high = np.where(few, low, (low + high) / 2), np.where(few, (low + high) / 2, high)
    y = np.exp((low + high) / 2)
    r, f = 1 - y, np.maximum((1 - y**discount) / discount, 1e-300)
    q = discount * prior * f
    mean, var = a / discount * q / (1 - q), a / discount * q / (1 - q) ** 2
    size = r * y ** (discount - 1) / f
    spread = np.maximum(0, size + r**2 * (1 - discount) * y ** (discount - 2) / f - size**2)
    return mean, np.sqrt(var * mean * spread / np.maximum(1e-300, mean * spread + var * size**2))


def seat(customers: np.ndarray, others: np.ndarray, prior: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given its customers and everything else: a blocked Gibbs step over all customers of the dish.

    ``others``: tables of the restaurant's other dishes; ``prior``: the parent's probability of the dish.  The number of tables t
    has the weight prod(strength + discount * (others + i), i < t) * prior^t * S(customers, t), S being the generalised Stirling
    number, so single customers need no seats of their own.  Up to ``EXACT`` customers the draw is exact.  Beyond, the tables of the first
    ``EXACT`` customers are weighed by what the rest makes of them, and the rest opens a negative binomial number, the limit for
    many more customers than tables; a dish that expects ``CROWDED`` tables or more is drawn from the saddle point's normal law.
    """
    tables = np.ones(len(customers), np.int64)
    first = np.minimum(customers, EXACT)
    a = strength + discount * others
    full = np.flatnonzero(customers > EXACT)
    crowded = np.zeros(len(customers), bool)
    if len(full):
        mean, deviation = _crowded(customers[full].astype(np.float64), a[full], prior[full], discount)
        big = mean >= CROWDED
        crowded[full[big]] = True
        tables[full[big]] = np.clip(np.rint(rng.normal(mean[big], deviation[big])), 1, customers[full[big]])
    low = 1
    for width in (8, 32, 128, EXACT):
        group = np.flatnonzero((first > low) & (first <= width) & ~crowded)
        low = width
        t = np.arange(1, width + 1)
        for start in range(0, len(group), (1 << 18) // width):
            at = group[start:start + (1 << 18) // width]
            weight = np.cumsum(np.log((a[at, None] + discount * (t - 1)) * prior[at, None]), axis=1) + _log_stirling(discount)[first[at], 1:width + 1]
            more = np.flatnonzero(customers[at] > EXACT)
            if len(more):
                c = customers[at[more], None].astype(np.float64)
                end = 1 - prior[at[more], None] * (1 - (EXACT / c) ** discount)
                weight[more] += _log_gamma(c - discount * t) - _log_gamma(EXACT - discount * t) - t * np.log(end)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1)
            if len(more):
                late = at[more]
                tables[late] = np.minimum(customers[late], tables[late] + rng.negative_binomial(a[late] / discount + tables[late], end[:, 0]))
    return tables


@dataclass
class Shard:
    """One shard's dishes and the chain over them."""
    word: np.ndarray          # distinct words, sorted
    first: np.ndarray         # dishes before each word and after the last
    key: np.ndarray
    ctx: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, count: np.ndarray) -> Shard:
        word = key >> _SHIFT
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        return cls(word[head], np.append(head, len(key)), key, (key & _CTX).astype(np.int64), count.astype(np.int64))

    def chain(self, s: Settings, history: list[Totals], shard: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables of each dish, the parent's customers and tables of each word): the first seating, then one sweep for each of
        ``history``."""
        tables = np.ones(len(self.key), np.int64)
        up = np.diff(self.first)
        parent = np.ones(len(self.word), np.int64)
        yield tables, up, parent
        several = np.flatnonzero(self.count > 1)
        of_word = np.repeat(np.arange(len(self.word)), np.diff(self.first))
        for sweep, totals in enumerate(history):
            rng = np.random.default_rng([s.seed, sweep, shard])
            prior = parent_prob(s, totals, up, parent)[of_word[several]]
            tables = tables.copy()
            tables[several] = seat(self.count[several], totals.tables[self.ctx[several]] - tables[several], prior, s.discount, s.strength, rng)
            up = np.add.reduceat(tables, self.first[:-1]) if len(self.word) else up
            base = np.full(len(up), 1 / (s.vocabulary + 1))
            parent = seat(up, totals.parent_tables - parent, base, s.parent_discount, s.strength, rng)
            yield tables, up, parent


def parent_prob(s: Settings, t: Totals, customers: np.ndarray | float, tables: np.ndarray | float):
    own = (customers - s.parent_discount * tables) + (s.strength + s.parent_discount * t.parent_tables) / (s.vocabulary + 1)
    return own / (s.strength + t.customers)


def dish_counts(docs: DataFrame, frequent: np.ndarray, n: int) -> DataFrame:
    """(shard, keys, counts): all (word, context) of the training texts with their customers, one row per shard."""
    first_key = bounds(n, WORD_BITS + CTX_BITS)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = [np.zeros(0, np.uint64)]
        for _, part in chunks([lowered(t) for t in batch.column(0).to_pylist()]):
            word, first = tokens(part)
            ctx, _ = contexts(word, first, frequent)
            keys.append((word << _SHIFT) | ctx.astype(np.uint64))
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        rows = slices(key, first_key)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([pack(key[a:b]) for _, a, b in rows], pa.binary()), pa.array([pack_small(times[a:b]) for _, a, b in rows], pa.binary())], ["shard", "keys", "counts"])

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        k = np.concatenate([unpack(x) for x in part.column("keys").to_pylist()])
        c = np.concatenate([unpack_small(x).astype(np.int64) for x in part.column("counts").to_pylist()])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([pack(k[head])], pa.binary()), "counts": pa.array([pack_small(np.add.reduceat(c, head))], pa.binary())})

    return batches(docs, count, "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(merge, "shard int, keys binary, counts binary")


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(hashes of the words that make up ``1 / SHARE`` of the tokens, number of tokens).

    A batch passes on only words of an eighth of that share of its own tokens, so a word's sum lacks less than an eighth of the
    share: all frequent words are among those of seven eighths, which are at most 8/7 SHARE.  Those whose sum falls short of the
    share are counted again in full, so the list depends on the texts alone, not on how they come in batches.
    """
    def counts(wanted: np.ndarray | None):
        def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words = [np.zeros(0, np.uint64)]
            for _, part in chunks([lowered(t) for t in batch.column(0).to_pylist()]):
                words.append(tokens(part)[0])
            word, times = np.unique(np.concatenate(words), return_counts=True)
            often = times * 8 * SHARE >= times.sum() if wanted is None else lookup(wanted, word)[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[often].astype(np.int64), -1)), pa.array(np.append(times[often], times.sum()).astype(np.int64))], ["word", "times"])

        return batches(docs, count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))

    counted = materialise(counts(None), "frequent")
    total = counted.filter("word = -1").first()
    if total is None:
        return np.zeros(0, np.uint64), 0
    rows = counted.filter((F.col("word") >= 0) & (F.col("times") * 8 * SHARE >= 7 * total.times)).collect()  # at most 8/7 SHARE
    sure = [r.word for r in rows if r.times * SHARE >= total.times]
    near = np.sort(np.array([r.word for r in rows if r.times * SHARE < total.times], np.uint64))
    if len(near):
        sure += [r.word for r in counts(near).filter((F.col("word") >= 0) & (F.col("times") * SHARE >= total.times)).collect()]
    return np.sort(np.array(sure, np.uint64)), total.times


@dataclass
class Model:
    dishes: DataFrame
    settings: Settings
    history: list[Totals]
    hot: np.ndarray           # log10 of the averaged probability: frequent word, context
    hot_base: np.ndarray      # log10 of the add-half probability of each frequent word


def fit(docs: DataFrame, learn: Column | None = None, text_col: str = "text", burn_in: int = 2, samples: int = 3, strength: float = 1.0, seed: int = 11) -> Model:
    """The model of all texts of the rows that meet ``learn``; null is an empty text, whose only token is its end.

    No training row: every token is unknown, with probability 1.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = (docs if learn is None else docs.filter(learn)).select(F.col(text_col).alias("text"))
    frequent, total = frequent_words(texts)
    dishes = materialise(dish_counts(texts, frequent, shards(spark)), "dishes")
    wide = len(frequent) + 1
    s = Settings(frequent, np.zeros(wide), 0, total, 0.5, 0.5, strength, seed, burn_in)
    history: list[Totals] = []
    for sweep in range(burn_in + samples + 1):
        rows = _summed(dishes, s, history)
        ctx = {r.ctx: r for r in rows}
        if not sweep:
            s.seated = np.array([float(ctx[i].a) if i in ctx else 0.0 for i in range(wide)])
            s.vocabulary = float(ctx[-1].c) if -1 in ctx else 0.0
            s.discount, s.parent_discount = (_discount(ctx.get(k)) for k in (-2, -3))
        history.append(Totals(np.array([float(ctx[i].b) if i in ctx else 0.0 for i in range(wide)]), float(ctx[-1].a) if -1 in ctx else 0.0, float(ctx[-1].b) if -1 in ctx else 0.0))
    hot = np.full((len(frequent), wide), 0.0)
    hot_base = np.zeros(len(frequent))
    for r in _hot_rows(dishes, s, history).collect():  # one bounded row for each frequent word
        i = int(np.searchsorted(frequent, r.word))
        hot[i], hot_base[i] = np.frombuffer(r.logp), r.base
    return Model(dishes, s, history, hot, hot_base)


def _discount(r) -> float:
    """The usual estimate from the counts of ones and twos, kept off its ends."""
    return min(0.95, max(0.05, r.a / (r.a + 2 * r.b))) if r is not None and r.a and r.b else 0.5


def _shards_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Shard]]:
    for shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
        yield shard, Shard.of(unpack(keys), unpack_small(counts))


def _summed(dishes: DataFrame, s: Settings, history: list[Totals]) -> list:
    """Totals of the seating after ``history``: by context customers and tables; -1 parent customers, tables, words; -2 and -3
    ones and twos of dishes and of words."""
    wide = len(s.frequent) + 1

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for shard, d in _shards_of(batch):
            for tables, up, parent in d.chain(s, history, shard):
                pass
            a = np.concatenate([np.bincount(d.ctx, d.count, wide), [up.sum(), (d.count == 1).sum(), (up == 1).sum()]])
            b = np.concatenate([np.bincount(d.ctx, tables, wide), [parent.sum(), (d.count == 2).sum(), (up == 2).sum()]])
            c = np.append(np.zeros(wide), [len(d.word), 0, 0])
            yield pa.RecordBatch.from_arrays([pa.array([shard % PARTS], pa.int32()), pa.array([np.stack([a, b, c]).astype(np.int64).tobytes()], pa.binary())], ["part", "totals"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        return pa.table({"totals": pa.array([sum(np.frombuffer(x, np.int64) for x in part.column("totals").to_pylist()).tobytes()], pa.binary())})

    # One row a shard, then one for each of a few parts: the rows do not grow with shards times contexts.
    sums = batches(dishes, run, "part int, totals binary").groupBy("part").applyInArrow(add, "totals binary").collect()
    a, b, c = sum((np.frombuffer(r.totals, np.int64) for r in sums), np.zeros(3 * (wide + 3), np.int64)).reshape(3, -1)
    return [Row(ctx=k, a=int(a[i]), b=int(b[i]), c=int(c[i])) for i, k in enumerate([*range(wide), -1, -2, -3])]


def _averaged(d: Shard, s: Settings, history: list[Totals], shard: int, dish: np.ndarray, word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Mean probability after the burn-in of (word place, context) pairs; ``dish`` is the pair's dish, either is -1 if unseen."""
    out = np.zeros(len(ctx))
    for sweep, (tables, up, parent) in enumerate(d.chain(s, history[:-1], shard)):
        if sweep <= s.burn_in:
            continue
        t = history[sweep]
        p = np.append(parent_prob(s, t, up, parent), parent_prob(s, t, 0, 0))[word]
        own = np.append(d.count - s.discount * tables, 0.0)[dish]
        out += (own + (s.strength + s.discount * t.tables[ctx]) * p) / (s.strength + s.seated[ctx])
    return out / (len(history) - 1 - s.burn_in)


def _base(s: Settings, count: np.ndarray) -> np.ndarray:
    return np.log10((count + 0.5) / (s.tokens + 0.5 * (s.vocabulary + 1)))


def _hot_rows(dishes: DataFrame, s: Settings, history: list[Totals]) -> DataFrame:
    wide = len(s.frequent) + 1

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for shard, d in _shards_of(batch):
            at, ok = lookup(s.frequent, d.word)
            place = np.flatnonzero(ok)
            ctx = np.tile(np.arange(wide), len(place))
            key = (np.repeat(d.word[place], wide) << _SHIFT) | ctx.astype(np.uint64)
            dish, seen = lookup(d.key, key)
            p = _averaged(d, s, history, shard, np.where(seen, dish, -1), np.repeat(place, wide), ctx)
            total = np.add.reduceat(d.count, d.first[:-1])[place] if len(place) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(d.word[place].astype(np.int64)), pa.array([x.tobytes() for x in np.log10(p).reshape(-1, wide)], pa.binary()), pa.array(_base(s, total), pa.float64())], ["word", "logp", "base"])

    return batches(dishes, run, "word long, logp binary, base double")


def score(model: Model, docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``score`` is the model's log10 probability of the text with its end, ``base_score`` the add-half unigram model's.  Null is an
    empty text.  Repeated rows and rows without an id are scored as rows of their own.  Other columns are not read.
    """
    s, history, hot, hot_base = model.settings, model.history, model.hot, model.hot_base

    def emit(texts: list[str | None]):
        rows, keys, docs_of = [], [], []
        for at, part in chunks([lowered(t) for t in texts]):
            word, first = tokens(part)
            ctx, place = contexts(word, first, s.frequent)
            doc, is_hot = per_text(first), place >= 0
            f = [np.bincount(doc[is_hot], w, len(part)) for w in (None, hot_base[place[is_hot]], hot[place[is_hot], ctx[is_hot]])]
            rows.append(np.stack([np.diff(first), *f], axis=1))
            keys.append((word[~is_hot] << _SHIFT) | ctx[~is_hot].astype(np.uint64))
            docs_of.append(doc[~is_hot] + at)
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(docs_of)

    def value(row: dict | None, key: np.ndarray) -> np.ndarray:
        d = Shard.of(unpack(row["keys"]), unpack_small(row["counts"])) if row else Shard.of(np.zeros(0, np.uint64), np.zeros(0))
        ctx = (key & _CTX).astype(np.int64)
        dish, seen = lookup(d.key, key)
        place, known = lookup(d.word, key >> _SHIFT)
        place = np.where(known, place, -1)
        p = _averaged(d, s, history, row["shard"], np.where(seen, dish, -1), place, ctx) if row else _unseen(s, history, ctx)
        count = np.append(np.add.reduceat(d.count, d.first[:-1]) if row else np.zeros(0), 0)[place]
        return np.stack([known, _base(s, count), np.log10(p)], axis=1)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    out = sharded_sums(rows, model.dishes, emit, value, shards(docs.sparkSession), WORD_BITS + CTX_BITS, ["n_tokens", "n_known", "base_score", "score"], ["n_known", "base_score", "score"])
    return out.select(F.col("id").alias(id_col), "held_out", F.round("n_tokens").cast("long").alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"),
                      F.lit(int(s.tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def _unseen(s: Settings, history: list[Totals], ctx: np.ndarray) -> np.ndarray:
    """The averaged probability of the unknown word."""
    out = np.zeros(len(ctx))
    for t in history[s.burn_in + 1:]:
        out += (s.strength + s.discount * t.tables[ctx]) * parent_prob(s, t, 0, 0) / (s.strength + s.seated[ctx])
    return out / max(1, len(history) - 1 - s.burn_in)

