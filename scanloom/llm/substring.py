"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of the last 16 bytes meets a condition: at about every second word end, rarely inside words, and
at about every 32nd character where no white space was in the last 64 bytes.  A cut depends on the bytes before it alone, so an
insertion moves only the cuts beside it.  A window is the fewest consecutive chunks from a cut on that hold ``window_words`` words;
where no white space was in the last 64 bytes (Chinese, Japanese, Thai, minified or encoded text), every 8 bytes count as a word
too.  A window is known by the 64-bit digest of its bytes.  A window that also stands in a document of smaller id is a repeat, and the chunks of repeated windows are removed: the
document with the smallest id keeps the passage.

Why windows and not single chunks: a chunk is two words on average, and short phrases and lines of boilerplate recur in clean
documents.  Windows recur only where a passage of ``window_words`` words does.

Digests meet in packed postings, a few bytes each: the documents are dealt once into groups by their id, as many as their bytes ask for; each group sends a window
once, however many of its documents hold it, with the smallest of their ids, and gets back the windows known from smaller ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.tables import hand_back, shards, ship_package
from scanloom.llm.words import chunks, pack, pack_small, prefix_hash, separators, span_hash, unpack, unpack_small

_SPACE = separators()
_GEAR = np.random.RandomState(5).randint(0, 1 << 16, 256).astype(np.uint32)
#: Bytes that the 16-bit hash looks back on, and the bits that must be zero at a word end and inside a word.
_LOOK, _AT_WORD, _INSIDE = 16, 1, 9
#: Bytes of text that a group of documents has on average; a group and its postings are held by one task at a time.
GROUP_BYTES = 12_000_000
#: Bytes without white space after which text counts as spaceless, the zero bits of a cut there, and the bytes that count as a word.
_FAR, _AT_FAR, _WORD = 64, 5, 8


def gear(buf: np.ndarray) -> np.ndarray:
    """16-bit gear hash after every byte: ``h = (h << 1) + gear[byte]``; only the last 16 bytes matter to it."""
    g = _GEAR[buf]
    h = g.copy()
    for j in range(1, min(_LOOK, len(buf))):
        h[j:] += g[:-j] << np.uint32(j)
    return (h & np.uint32(0xFFFF)).astype(np.uint16)


def spaceless(space: np.ndarray) -> np.ndarray | None:
    """Whether the ``_FAR`` bytes before each place, and before the end, hold no white space; None if that is so nowhere."""
    at = np.concatenate([[-1], np.flatnonzero(space), [len(space)]])
    long = np.flatnonzero(np.diff(at) > _FAR)
    if not len(long):
        return None
    edge = np.zeros(len(space) + 2, np.int8)
    edge[at[long] + 1 + _FAR] = 1
    edge[at[long + 1] + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def windows(texts: list[bytes], window_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: (cuts, last cut of each chunk's window or -1, digest of each window); chunk i is cuts[i]:cuts[i + 1]."""
    for _, part in chunks(texts, 1 << 19):
        buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        prefix, h = prefix_hash(buf), gear(buf)
        space = _SPACE[buf]
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1                    # a word ends before here
        # The high bits of the hash hold the most bytes.
        at_word = ends[(h[ends - 1] >> np.uint16(16 - _AT_WORD)) == 0]
        lead = (buf & 0xC0) != 0x80                                           # never inside a character
        inside = np.flatnonzero(((h[:-1] >> np.uint16(16 - _INSIDE)) == 0) & lead[1:]) + 1
        cut = np.union1d(at_word, inside)
        far = spaceless(space)
        if far is not None:
            cut = np.union1d(cut, np.flatnonzero(((h[:-1] >> np.uint16(16 - _AT_FAR)) == 0) & lead[1:] & far[1:-1]) + 1)
            far = np.cumsum(far)
        a = 0
        for t in part:
            b = a + len(t)
            own = cut[np.searchsorted(cut, a, "right"):np.searchsorted(cut, b)]
            cuts = np.concatenate([[a], own, [b]]) if b > a else np.array([a])
            words = np.searchsorted(ends, cuts, "right")                      # words ended up to each cut
            weight = words * _WORD if far is None else words * _WORD + far[cuts]
            last = np.searchsorted(weight, weight[:-1] + window_words * _WORD)
            ok = last < len(cuts)
            last = np.where(ok, last, -1)
            digest = np.zeros(len(last), np.uint64)
            digest[ok] = span_hash(prefix, cuts[:-1][ok], cuts[last[ok]])
            yield cuts - a, last, digest
            a = b + 1


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, smallest id of each)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], ids[head]


def _of_group(ids: list, cut: list) -> tuple[np.ndarray, np.ndarray]:
    """(distinct digests, smallest id of each) of one group's documents that have an id."""
    own = [(i, np.unique(digest[last >= 0])) for i, (_, last, digest) in zip(ids, cut) if i is not None]
    digests = np.concatenate([np.zeros(0, np.uint64), *(d for _, d in own)])
    return _least(digests, np.repeat(np.array([i for i, _ in own], np.int64), [len(d) for _, d in own]))


def remove_repeats(docs: DataFrame, window_words: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of ``text_col``, plus ``removed_spans`` and ``removed_bytes``.

    A passage that also stands in a document of smaller id is removed up to the cuts next to its ends, about two words each, if it
    holds a window: ``window_words`` words from one cut to another, the first cut at least 16 bytes after its start or at the start
    of both texts.  So a passage of just ``window_words`` words is mostly kept, and one some ten words longer is mostly found.  In
    spaceless text a window is ``8 * window_words`` bytes from cut to cut, beginning 64 bytes or more after the last white space
    or the passage's start, and about 32 characters are left at each end.  ``removed_spans`` holds [start, end) in bytes of the UTF-8 text.  Repeats inside one document, and
    between rows of one id, stay.  Null and shorter texts and rows without an id come back unchanged.  All other columns are kept;
    columns of the names added here are replaced.  Empty table: no rows.
    """
    ship_package(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first().n or 0
    n = max(shards(docs.sparkSession), math.ceil(size / GROUP_BYTES))
    group = "_substring_group"
    names = [c for c in docs.columns if c not in ("removed_spans", "removed_bytes", group)]
    # Rows without an id repeat nothing and pass by.
    known_id = F.col(id_col).cast("long").isNotNull()
    beside = docs.filter(~known_id).select(*names, F.array().cast("array<array<bigint>>").alias("removed_spans"), F.lit(0).cast("bigint").alias("removed_bytes"))
    # Both passes read all columns of ``dealt``, so the texts are shuffled once and that exchange is used twice.
    dealt = docs.filter(known_id).select(*names, F.pmod(F.hash(F.col(id_col).cast("long")), F.lit(n)).alias(group))
    bounds = np.arange(n, dtype=np.uint64) * np.uint64(2**64 // n)

    def read(part: pa.Table):
        texts = part.column(text_col).to_pylist()
        ids = part.column(id_col).cast(pa.int64()).to_pylist()
        return texts, ids, list(windows([_bytes(t) for t in texts], window_words))

    def post(key: tuple, part: pa.Table) -> pa.Table:
        hand_back()
        _, ids, cut = read(part)
        d, low = _of_group(ids, cut)
        at = np.append(np.searchsorted(d, bounds), len(d)).tolist()
        rows = [(s, a, b) for s, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        return pa.table({"grp": pa.array([key[0].as_py()] * len(rows), pa.int32()), "shard": pa.array([r[0] for r in rows], pa.int32()),
                         "keys": pa.array([pack(d[a:b]) for _, a, b in rows], pa.binary()),
                         "ids": pa.array([pack_small(low[a:b].view(np.uint64)) for _, a, b in rows], pa.binary())})

    def meet(part: pa.Table) -> pa.Table:
        hand_back()
        keys = [unpack(x) for x in part.column("keys").to_pylist()]
        ids = [unpack_small(x).astype(np.uint64).view(np.int64) for x in part.column("ids").to_pylist()]
        all_keys, least = _least(np.concatenate(keys), np.concatenate(ids))
        back = [k[least[np.searchsorted(all_keys, k)] < i] for k, i in zip(keys, ids)]
        out = [(g, pack(k)) for g, k in zip(part.column("grp").to_pylist(), back) if len(k)]
        return pa.table({"grp": pa.array([g for g, _ in out], pa.int32()), "keys": pa.array([k for _, k in out], pa.binary())})

    out_schema = dealt.select(*names).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def cut_out(part: pa.Table, known: pa.Table) -> pa.Table:
        hand_back()
        texts, ids, cut = read(part)
        d, low = _of_group(ids, cut)
        low[np.isin(d, np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x in known.column("keys").to_pylist())]))] = np.iinfo(np.int64).min
        new, spans, sizes = [], [], []
        for text, i, (cuts, last, digest) in zip(texts, ids, cut):
            ok = np.flatnonzero(last >= 0)
            if i is not None and len(ok):
                ok = ok[low[np.searchsorted(d, digest[ok])] < i]
            if i is None or not len(ok):
                new.append(text)
                spans.append([])
                sizes.append(0)
                continue
            depth = np.zeros(len(cuts), np.int64)
            np.add.at(depth, ok, 1)
            np.add.at(depth, last[ok], -1)
            gone = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
            edge = np.flatnonzero(gone[1:] != gone[:-1])
            ranges = cuts[edge].reshape(-1, 2).tolist()
            raw = _bytes(text)
            keep = np.concatenate([[0], cuts[edge], [len(raw)]]).reshape(-1, 2).tolist()
            new.append(b"".join(raw[a:b] for a, b in keep).decode("utf-8", "surrogatepass"))
            spans.append(ranges)
            sizes.append(sum(b - a for a, b in ranges))
        out = part.select(names)
        out = out.set_column(names.index(text_col), text_col, pa.array(new, pa.string()))
        return out.append_column("removed_spans", pa.array(spans, pa.list_(pa.list_(pa.int64())))).append_column("removed_bytes", pa.array(sizes, pa.int64()))

    posted = dealt.groupBy(group).applyInArrow(post, "grp int, shard int, keys binary, ids binary")
    repeats = posted.groupBy("shard").applyInArrow(meet, "grp int, keys binary")
    both = dealt.groupBy(group).cogroup(repeats.groupBy("grp"))
    cut = both.applyInArrow(cut_out, f"{out_schema}, removed_spans array<array<bigint>>, removed_bytes bigint")
    return cut.unionByName(beside)
