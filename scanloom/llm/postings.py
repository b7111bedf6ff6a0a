"""Sums over a document's tokens of values that live in a sharded table.

Tokens are 64-bit keys, or fewer bits.  What a task can decide itself it adds up where the text is read; every other token travels
to its key's shard in packed postings, some bytes each, meets the table there, and comes back as one sum per document and shard.
A batch of documents is known by the number of its first row, counted over partitions as they are read; its kept columns travel
with it, so no column of the caller is ever a join key and repeated rows and null ids stay rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from scanloom.llm.tables import hand_back
from scanloom.llm.words import pack, pack_small, unpack, unpack_small

_SENT = pa.schema([("shard", pa.int32()), ("uid", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("own", pa.binary()), ("kept", pa.binary())])
_SENT_SQL = "shard int, uid long, size int, keys binary, docs binary, own binary, kept binary"
_BACK = pa.schema([("uid", pa.int64()), ("own", pa.binary()), ("kept", pa.binary())])
#: Splits a 64-bit row number: rows of one partition.
_ROWS = 40


def bounds(n: int, bits: int) -> np.ndarray:
    """First key of each of ``n`` shards of equal ranges."""
    return np.arange(n, dtype=np.uint64) * np.uint64(min((1 << bits) // n, (1 << 64) - 1))


def slices(key: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys, without empty shards."""
    at = np.append(np.searchsorted(key, first), len(key)).tolist()
    return [(s, a, b) for s, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def sharded_sums(docs: DataFrame, table: DataFrame, emit: Callable, value: Callable, n: int, bits: int, sums: list[str], sharded: list[str], kind: type = np.float64) -> DataFrame:
    """All columns of ``docs`` but ``text``, and the columns ``sums``, for every row of ``docs``.

    ``emit(texts)`` gives (rows x sums decided here, keys, row of each key); ``value(row, keys)`` gives the (keys x ``sharded``)
    values of sorted distinct keys from a shard's row of ``table`` as a dict, or None where the table has no such shard.
    ``sharded`` names the sums that shards add to, ``kind`` the number type in which their part travels.
    """
    kept_schema = docs.drop("text").schema
    first = bounds(n, bits)
    width, into = len(sums), [sums.index(c) for c in sharded]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << _ROWS
        for batch in it:
            if not batch.num_rows:
                continue
            text = batch.schema.get_field_index("text")
            own, key, doc = emit(batch.column(text).to_pylist())
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            kept = batch.select([i for i in range(batch.num_columns) if i != text])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as w:
                w.write_batch(kept)
            rows = [{"shard": (uid >> 10) % n, "uid": uid, "size": len(own), "own": own.astype(float).tobytes(), "kept": sink.getvalue().to_pybytes()}]
            rows += [{"shard": s, "uid": uid, "size": len(own), "keys": pack(key[a:b]), "docs": pack_small(doc[a:b])} for s, a, b in slices(key, first)]
            yield pa.RecordBatch.from_pylist(rows, _SENT)
            uid += batch.num_rows

    def meet(sent: pa.Table, shard: pa.Table) -> pa.Table:
        hand_back()
        got = sent.to_pylist()
        out = [{k: r[k] for k in ("uid", "own", "kept")} for r in got if r["own"] is not None]
        posts = [r for r in got if r["own"] is None]
        if posts:
            keys = [unpack(r["keys"]) for r in posts]
            every, back = np.unique(np.concatenate(keys), return_inverse=True)
            values = value(shard.to_pylist()[0] if shard.num_rows else None, every)
            at = 0
            for r, k in zip(posts, keys):
                mine, doc = values[back[at:at + len(k)]], unpack_small(r["docs"]).astype(np.int64)
                at += len(k)
                own = np.stack([np.bincount(doc, mine[:, c], r["size"]) for c in range(len(into))])
                out.append({"uid": r["uid"], "own": own.astype(kind).tobytes(), "kept": None})
        return pa.Table.from_pylist(out, _BACK)

    def add(part: pa.Table) -> pa.Table:
        rows = list(zip(part.column("own").to_pylist(), part.column("kept").to_pylist()))
        total = next(np.frombuffer(own).reshape(-1, width) for own, kept in rows if kept is not None).copy()
        for own, kept in rows:
            if kept is None:
                total[:, into] += np.frombuffer(own, kind).reshape(len(into), -1).T
        kept = pa.ipc.open_stream(next(kept for _, kept in rows if kept is not None)).read_all()
        for i, name in enumerate(sums):
            kept = kept.append_column(name, pa.array(total[:, i]))
        return kept

    sent = docs.mapInArrow(read, _SENT_SQL)
    back = sent.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(meet, "uid long, own binary, kept binary")
    schema = StructType(list(kept_schema.fields) + StructType.fromDDL(", ".join(f"{c} double" for c in sums)).fields)
    return back.groupBy("uid").applyInArrow(add, schema)
