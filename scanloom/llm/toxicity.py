"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of rows of hashed tables: two for the word and three for its first 4 and 5 bytes, each addressed by
other bits of a hash, so two words are confused only if all of them collide and inflected or disguised forms share a part.  Filters of several widths run over the whole text, max pooling keeps each filter's strongest place, and a
logistic layer gives the score.  Text only: label, language, source and id are never inputs.

The model is fitted on whole texts of all labelled rows but a fifth, whose scores set the thresholds.  Documents and labels are dealt by
hash of the id into shards of some ``SHARD`` labelled texts and ``SHARD_BYTES`` bytes and meet there, so a text is shuffled once, at any
size, and most of those without a label not at all; rows of an id that has more than a shard are dealt by their number, so no id makes a
shard large, and long texts are read in steps; the log-odds are
summed over all shards, then every shard trains an epoch from the common parameters and their mean, weighted by texts, starts the next
(shards send what changed, cut into ``SLICES`` that are summed apart).  The model is some MB of fixed size, and the driver sees one sum
of each slice; scoring is narrow, in batches, over whole texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.tables import batches, hand_back, materialise, ship_package
from scanloom.llm.words import PLAIN, chunks, lowered, pieces, prefix_hash, separators, span_hash, spans

HASHES, BITS, DIM, FILTERS, WIDTHS = 5, 14, 8, 8, (1, 2, 3)
# Labelled texts of a shard and their bytes; slices of what shards send; steps of the scores that thresholds tell apart.
SHARD, SHARD_BYTES, SLICES, GRID = 4096, 1 << 25, 64, 1 << 16
# Bytes of texts whose words are looked up together: what a task holds follows it, not the size of a batch.
TOGETHER = 1 << 17
# Words of a text that a training step looks at together.
STEP = 1 << 16
# Most bits of the filter that keeps texts without a label where they are read; a full one lets them pass, so it bounds nothing.
FILTER_BITS = 1 << 26
_TABLE = separators(PLAIN)


@dataclass
class Model:
    emb: np.ndarray                     # hash, bucket, dim
    conv: list[np.ndarray]              # per width: offset, dim, filter
    bias: np.ndarray                    # width * filter
    out: np.ndarray                     # width * filter
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)  # by language
    threshold: float = 0.5              # of other languages


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of every word, words before each text and after the last)."""
    buf, start, end, first = spans(texts, _TABLE)
    prefix = prefix_hash(buf)
    word, four, five = (span_hash(prefix, start, np.minimum(end, start + n)) for n in (len(buf), 4, 5))
    mask = np.uint64((1 << BITS) - 1)
    cut = [word, word >> np.uint64(20), four, four >> np.uint64(20), five >> np.uint64(40)]
    return np.stack([(h & mask).astype(np.int32) for h in cut], axis=1), first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_texts(model: Model, texts: Sequence[str | None]) -> np.ndarray:
    """Scores of whole texts; filters become sums of table rows, so a word costs ``HASHES`` row reads.  Empty: the bias alone."""
    cols = np.concatenate([np.concatenate(list(w), axis=1) for w in model.conv], axis=1)
    tables = [(e @ cols).astype(np.float32) for e in model.emb]
    gap = max(WIDTHS) - 1

    def looked_up(b: np.ndarray) -> np.ndarray:
        y = tables[0][b[:, 0]]
        for k in range(1, HASHES):
            y += tables[k][b[:, k]]
        return y

    def places(x: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Per width the filters' values at the first ``n`` places of ``x``."""
        col = 0
        for width in WIDTHS:
            z = 0
            for o in range(width):
                z = z + x[o:o + n, col:col + FILTERS]
                col += FILTERS
            yield z

    def strongest(text: bytes) -> np.ndarray:
        """The same for one long text, in steps: its last words wait for those that follow."""
        best, held = np.full(len(model.bias), -np.inf, np.float32), np.zeros((0, cols.shape[1]), np.float32)
        for piece in (*pieces(text, _TABLE, TOGETHER), None):
            more = np.zeros((gap, cols.shape[1]), np.float32) if piece is None else looked_up(_buckets([piece])[0])
            x = np.concatenate([held, more])
            if len(x) > gap:
                best = np.maximum(best, np.concatenate([z.max(axis=0) for z in places(x, len(x) - gap)]))
            held = x[-gap:].copy()
        return np.where(np.isfinite(best), best, 0)

    scores = np.zeros(len(texts))
    for at, part in chunks((lowered(t) for t in texts), TOGETHER):
        pooled = np.zeros((len(part), len(model.bias)), np.float32)
        if len(part[0]) > TOGETHER:  # alone
            pooled[0] = strongest(part[0])
        else:
            b, first = _buckets(part)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                n = np.diff(first)
                start = first[:-1] + gap * np.arange(len(part))
                x = np.zeros((len(b) + gap * len(part) + gap, cols.shape[1]), np.float32)
                place = np.arange(len(b)) + gap * np.repeat(np.arange(len(part)), n)
                x[place] = looked_up(b)
                edges = np.stack([start[full], start[full] + n[full]], axis=1).reshape(-1)
                for w, z in enumerate(places(x, len(x) - gap)):
                    z = np.concatenate([z, np.zeros((1, FILTERS), np.float32)])
                    pooled[full, w * FILTERS:(w + 1) * FILTERS] = np.maximum.reduceat(z, edges, axis=0)[::2]
        act = np.maximum(pooled + model.bias, 0)
        scores[at:at + len(part)] = _sigmoid(act @ model.out + model.base)
    return scores


def _held(words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Clean and toxic texts that hold each table row."""
    held = np.zeros((2, HASHES, 1 << BITS))
    for b, label in zip(words, y):
        for h in range(HASHES):
            held[int(label), h, np.unique(b[:, h])] += 1
    return held


def _log_odds(held: np.ndarray, share: float, weight: float = 8.0) -> np.ndarray:
    """Where the embeddings start: how much likelier a toxic text holds a table row than a clean one, drawn towards no difference."""
    return np.log((held[1] + weight * share) / (held.sum(axis=0) + weight) / share)


def _start(log_odds: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.RandomState(seed)
    f32 = np.float32
    p = {"emb": rng.normal(0, 0.3, (HASHES, 1 << BITS, DIM)).astype(f32), "bias": np.zeros(len(WIDTHS) * FILTERS, f32),
         "out": np.abs(rng.normal(0, 0.5, len(WIDTHS) * FILTERS)).astype(f32) * np.tile([1, 1, 1, -1], len(WIDTHS) * FILTERS // 4).astype(f32), "base": np.array([-1.0], f32)}
    p |= {f"w{w}": rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(f32) for w in WIDTHS}
    p["emb"][:, :, 0] = log_odds
    for k, w in enumerate(WIDTHS):  # the first filter of each width starts as a reader of the log-odds
        p[f"w{w}"][:, :, 0], p[f"w{w}"][:, 0, 0] = 0, 1
        p["bias"][k * FILTERS], p["out"][k * FILTERS] = -4, 0.5
    return p


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: x.reshape(like[k].shape).astype(np.float32) for k, x in zip(sorted(like), np.split(flat, ends[:-1]))}


def _embedded(p: dict[str, np.ndarray], b: np.ndarray) -> np.ndarray:
    return p["emb"][np.arange(HASHES), b].sum(axis=1)


def _epoch(p: dict[str, np.ndarray], words: list[np.ndarray], y: np.ndarray, epoch: int, seed: list[int], batch: int = 64, rate: float = 0.02) -> None:
    """One pass over a shard's texts, which changes the parameters in place."""
    rng = np.random.RandomState(seed)
    f32 = np.float32
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    order = rng.permutation(len(words))
    for at in range(0, len(order), batch):
        ids = order[at:at + batch]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        read, moved = [], []
        for i in ids:
            b = words[i]
            pad = np.zeros((max(WIDTHS), DIM), f32)  # so that even a text without words has a place for each part of a filter
            e = pad
            pooled, spots = np.zeros(len(WIDTHS) * FILTERS, f32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
            for start in range(0, len(b), STEP):
                e = np.concatenate([_embedded(p, b[start:start + STEP + len(pad)]), pad])
                n = min(STEP, len(b) - start)
                for k, w in enumerate(WIDTHS):
                    z = sum(e[o:o + n] @ p[f"w{w}"][o] for o in range(w))
                    s = z.argmax(axis=0)
                    top, own = z[s, np.arange(FILTERS)], slice(k * FILTERS, (k + 1) * FILTERS)
                    better = (top > pooled[own]) | (start == 0)
                    spots[own], pooled[own] = np.where(better, start + s, spots[own]), np.where(better, top, pooled[own])
            act = np.maximum(pooled + p["bias"], 0)
            d = f32((_sigmoid(act @ p["out"] + p["base"][0]) - y[i]) / len(ids))
            g["out"] += d * act
            g["base"] += d
            back = d * p["out"] * (act > 0)
            g["bias"] += back
            for k, w in enumerate(WIDTHS):
                bk, sk = back[k * FILTERS:(k + 1) * FILTERS], spots[k * FILTERS:(k + 1) * FILTERS]
                for o in range(w):
                    at_o = sk + o
                    real = at_o < len(b)
                    there = e[at_o] if len(b) <= STEP else _embedded(p, b[np.minimum(at_o, len(b) - 1)]) * real[:, None]
                    g[f"w{w}"][o] += there.T * bk
                    if real.any():
                        read.append(b[at_o[real]])
                        moved.append((p[f"w{w}"][o] * bk).T[real])
        if read:
            np.add.at(g["emb"], (np.arange(HASHES), np.concatenate(read)), np.concatenate(moved)[:, None, :])
        step += 1
        for k in p:
            m[k] += f32(0.1) * (g[k] - m[k])
            v2[k] += f32(0.001) * (g[k] * g[k] - v2[k])
            p[k] -= f32(rate / (1 + epoch)) * (m[k] / f32(1 - 0.9 ** step)) / (np.sqrt(v2[k] / f32(1 - 0.999 ** step)) + f32(1e-6))


def _best_cut(score: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of best F1, in the middle of the gap it lies in, from the numbers of texts at each distinct score."""
    order = np.argsort(-score)
    score, hit, taken = score[order], np.cumsum(toxic[order]), np.cumsum((clean + toxic)[order])
    k = int((2 * hit / (taken + toxic.sum())).argmax())
    return float((score[k] + (score[k + 1] if k + 1 < len(score) else 0)) / 2)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, text, lang, y, h, bytes) of every row with a text and a label; h is a hash of the id, bytes the text's size, known before the join."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.octet_length(text_col).alias("bytes"))
    known = _labels(docs, labels, learn, id_col)
    return rows.join(known, id_col).select(F.col(id_col).cast("long").alias("id"), "text", "lang", "y", _hash(id_col).alias("h"), "bytes")


def _labels(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str) -> DataFrame:
    """(id, y): one label an id, which has the type it has in ``docs``."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & learn)
    return known.groupBy(F.col(id_col).cast(docs.schema[id_col].dataType).alias(id_col)).agg(F.max("toxic").cast("int").alias("y"))


def _hash(id_col: str) -> Column:
    return F.abs(F.xxhash64(id_col) % (1 << 40))


def _bits(known: DataFrame, size: int) -> np.ndarray:
    """``size`` bits, of which those of the hashes ``h`` of labelled ids are set; slices are made apart and laid beside each other."""
    step = max(8, size // SLICES)

    def mark(key: tuple, part: pa.Table) -> pa.Table:
        bits = np.zeros(step, bool)
        bits[part.column("bit").to_numpy() - key[0].as_py() * step] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bit = (F.col("h") % size).alias("bit")
    rows = known.select(bit).select("bit", F.expr(f"bit DIV {step}").cast("int").alias("slice"))
    out = np.zeros((size // step, step // 8), np.uint8)
    for r in rows.groupBy("slice").applyInArrow(mark, "slice int, bits binary").collect():
        out[r.slice] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _maybe(bits: np.ndarray, h: Column) -> Column:
    """False only for ids that have no label."""
    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        at = h.to_numpy() % (8 * len(bits))
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return marked(h)


def _dealt(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, int, int, int, int]:
    """((shard, texts), training shards, training texts, toxic ones, by how much toxic texts outnumber clean ones in all shards): every
    row with a text and a label.

    ``texts`` are a shard's (id, text, lang, y) as a compressed Arrow stream; a fifth, by hash of the id, stands in shards after those for training.
    """
    rows = labelled(docs, labels, learn, id_col, text_col, lang_col)
    each = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"), F.sum("bytes").alias("bytes"))
    over = (F.col("n") > SHARD) | (F.col("bytes") > SHARD_BYTES)
    n = each.groupBy((F.col("h") % 5 == 4).alias("held")).agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "bytes")), F.count_if(over & (F.col("n") > 1)).alias("many")).collect()
    (size, toxic, heavy, many), (other, other_toxic, other_heavy, other_many) = ([sum(r[k] for r in n if r.held == x) for k in ("n", "toxic", "bytes", "many")] for x in (False, True))
    count, more = (max(1, -(-a // SHARD), -(-b // SHARD_BYTES)) for a, b in ((size, heavy), (other, other_heavy)))
    h = _hash(id_col)
    held = h % 5 == 4
    shard = F.when(held, count + F.floor(h / 5 % more)).otherwise(F.floor(h / 5 % count)).cast("int").alias("shard")
    known = _labels(docs, labels, learn, id_col)
    bits = _bits(known.select(h.alias("h")), 1 << max(10, min(FILTER_BITS.bit_length() - 1, (8 * (size + other)).bit_length())))
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & learn).filter(_maybe(bits, h))
    kept = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")]
    if many + other_many:
        # Rows of an id that has more than a shard go to all shards of its side in turn, and its label to each of them.
        wide = materialise(each.filter(over & (F.col("n") > 1)).select(F.col("id").alias("wide_id")), "wide")
        far = F.when(held, F.sequence(F.lit(count), F.lit(count + more - 1))).otherwise(F.sequence(F.lit(0), F.lit(count - 1)))
        turn = F.when(held, count + F.pmod("turn", F.lit(more))).otherwise(F.pmod("turn", F.lit(count))).cast("int")
        is_wide = lambda df: df.join(wide, F.col(id_col) == F.col("wide_id"), "left")
        texts = is_wide(rows.withColumn("turn", F.monotonically_increasing_id())).select(F.when(F.col("wide_id").isNull(), shard).otherwise(turn).alias("shard"), *kept)
        known = is_wide(known).select(F.explode(F.when(F.col("wide_id").isNull(), F.array(shard)).otherwise(far)).alias("shard"), F.col(id_col).alias("id"), "y")
    else:
        texts = rows.select(shard, *kept)
        known = known.select(shard, F.col(id_col).alias("id"), "y")

    def meet(key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        hand_back()
        at = pc.index_in(texts.column("id"), value_set=marks.column("id").combine_chunks())
        own = texts.select(["id", "text", "lang"]).filter(at.is_valid())
        own = own.append_column("y", marks.column("y").take(at.drop_null()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(own)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    met = texts.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(meet, "shard int, texts binary")
    return met, count, size, toxic, 2 * (other_toxic + toxic) - (other + size)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
    """(shard, its texts) of rows of shards, one at a time."""
    for shard, table in zip(batch.column(0).to_pylist(), batch.column(1)):
        with pa.ipc.open_stream(table.as_buffer()) as stream:
            yield shard, stream.read_all()


def _texts(part: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """(table rows of the words of each text, labels), in an order that follows from ids and texts."""
    part = part.sort_by([("id", "ascending"), ("text", "ascending")])
    words = []
    for _, some in chunks((lowered(t.as_py()) for t in part.column("text")), TOGETHER):
        if len(some[0]) > TOGETHER:  # alone
            words.append(np.concatenate([_buckets([x])[0].astype(np.uint16) for x in pieces(some[0], _TABLE, TOGETHER)]))
            continue
        rows, first = _buckets(some)
        words += [rows[a:b].astype(np.uint16) for a, b in zip(first[:-1], first[1:])]
    return words, part.column("y").to_numpy().astype(np.float32)


def _sums(shards: DataFrame, fn: Callable[[int, list[np.ndarray], np.ndarray], np.ndarray]) -> DataFrame:
    """(slice, out): the sum over shards of one array of fixed size that ``fn(shard, words, y)`` gives, cut into ``SLICES``."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for shard, table in _read(batch):
            out = np.array_split(fn(shard, *_texts(table)).astype(np.float32), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], ["slice", "out"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = 0
        for x in part.column("out"):
            total = total + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "out": pa.array([total.tobytes()], pa.binary())})

    return batches(shards, run, "slice int, out binary").groupBy("slice").applyInArrow(add, "slice int, out binary")


def _over_shards(shards: DataFrame, fn: Callable[[int, list[np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of :func:`_sums` in one array."""
    return np.concatenate([np.frombuffer(r.out, np.float64) for r in sorted(_sums(shards, fn).collect(), key=lambda r: r.slice)])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, epochs: int = 5, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from ``labels.toxic`` of all rows that meet ``learn``; a fifth of them, by hash of the id, calibrates the thresholds.

    ``learn`` is a condition on the id.  Repeated labels of an id: toxic wins.  No positive or no negative row: a model that gives
    the share of positives (0 if there are none) to every text.
    """
    ship_package(docs.sparkSession)
    dealt, count, size, toxic, lead = _dealt(docs, labels, F.lit(True) if learn is None else learn, id_col, text_col, lang_col)
    if not 0 < toxic < size:
        model = Model(np.zeros((HASHES, 1 << BITS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0)
        model.base = 20.0 if lead > 0 else -20.0
        return model
    dealt = materialise(dealt, "labelled")
    shards = dealt.filter(F.col("shard") < count)
    has = _over_shards(shards, lambda shard, words, y: _held(words, y)).reshape(2, HASHES, 1 << BITS)
    p = _start(_log_odds(has, toxic / size), seed)
    for epoch in range(epochs):
        def run(shard: int, words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
            own = {k: v.copy() for k, v in p.items()}
            _epoch(own, words, y, epoch, [seed, epoch, shard])
            return (_flat(own) - _flat(p)) * len(y)  # mostly zeros: rows of words that lead no filter stay

        p = _shaped(_flat(p) + _over_shards(shards, run) / size, p)
    model = Model(p["emb"], [p[f"w{w}"] for w in WIDTHS], p["bias"], p["out"], float(p["base"][0]))

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        at, clean, toxic = (group[c].to_numpy(np.float64) for c in ("at", "clean", "toxic"))
        return pd.DataFrame({"lang": group["lang"][:1], "every": group["every"][:1], "clean": [clean.sum()], "toxic": [toxic.sum()], "cut": [_best_cut(at / GRID, clean, toxic)]})

    def rate(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, part in _read(batch):
            at = np.floor(score_texts(model, part.column("text").to_pandas()) * GRID + 0.5).astype(np.int32)
            yield from part.select(["lang", "y"]).append_column("at", pa.array(at)).to_batches()

    scored = batches(dealt.filter(F.col("shard") >= count), rate, "lang string, y int, at int")
    each = scored.select("y", "at", F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit("").alias("lang")), F.struct(F.lit(False).alias("every"), F.col("lang")))).alias("g"))
    counts = each.select("g.*", "y", "at").filter("lang IS NOT NULL").groupBy("every", "lang", "at").agg(F.count_if(F.col("y") == 0).alias("clean"), F.sum("y").alias("toxic"))
    for r in counts.groupBy("every", "lang").applyInPandas(cut, "lang string, every boolean, clean double, toxic double, cut double").orderBy("lang").collect():  # one row a language
        if r.every and r.clean and r.toxic:
            model.threshold = r.cut
        elif not r.every and r.clean >= 10 and r.toxic >= 10:
            model.thresholds[r.lang] = r.cut
    return model


def _score_buckets(model: Model, words: list[np.ndarray]) -> np.ndarray:
    out = []
    for b in words:
        e = np.concatenate([model.emb[np.arange(HASHES), b].sum(axis=1) if len(b) else np.zeros((0, DIM), np.float32), np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
        pooled = [sum(e[o:o + len(b)] @ w[o] for o in range(len(w))).max(axis=0) if len(b) else np.zeros(FILTERS) for w in model.conv]
        out.append(_sigmoid(np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.base))
    return np.array(out)


def toxicity_score(model: Model, text: Column) -> Column:
    """Score 0 to 1 of each whole text; null and empty texts get the score of no words."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = pd.Series(score_texts(model, texts))
        hand_back()
        return out

    return scored(text)


def language_threshold(model: Model, lang: Column) -> Column:
    """The calibrated threshold of the row's language; of an unknown or null language the common one."""
    known = [(lang == name, F.lit(cut)) for name, cut in model.thresholds.items()]
    if not known:
        return F.lit(model.threshold)
    out = F.when(*known[0])
    for case in known[1:]:
        out = out.when(*case)
    return out.otherwise(model.threshold)
