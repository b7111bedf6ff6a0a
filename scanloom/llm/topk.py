"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are dealt into blocks.  In a block every component has its values as a list in descending and, for negative weights, in
ascending order.  All lists are read sequentially to the same depth.  What has been read of a vector is known; the rest lies between
the last value read and the end of the list, which gives each vector a lower and an upper bound for each query.  Outsiders whose
upper bound is below the k-th best lower bound cannot qualify.  Reading stops when few enough remain, and their scores are resolved.
Bounds of many queries and vectors at a time are matrix products over the values read.

Every query block meets every candidate block once, in one task of bounded memory; each meeting gives at most k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.tables import materialise, ship_package

#: Vectors and queries of a block, and the depths read to, as shares of the lists.
BLOCK, QUERIES, DEPTHS = 8192, 1024, (0.6, 0.9, 0.97)


def nra(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, few: int = 8) -> list[np.ndarray]:
    """For each query the places of all vectors that may be among its k best; ``own`` is the place left out, or -1.

    Nothing of the k best is left out, ties included.  ``few``: a query stops reading when at most ``few * k`` remain.
    """
    n = len(vectors)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    order = np.argsort(vectors, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    out: list[np.ndarray] = [np.arange(n)] * len(queries)
    active = np.arange(len(queries))
    for share in DEPTHS:
        depth = math.ceil(share * n)
        if n <= few * k or depth >= n or not len(active):
            break
        top_seen, low_seen = rank >= n - depth, rank < depth
        top_last = np.take_along_axis(vectors, order[n - depth][None], axis=0)[0]
        low_last = np.take_along_axis(vectors, order[depth - 1][None], axis=0)[0]
        lower = up[active] @ np.where(top_seen, vectors, low).T + down[active] @ np.where(low_seen, vectors, high).T
        upper = up[active] @ np.where(top_seen, vectors, top_last).T + down[active] @ np.where(low_seen, vectors, low_last).T
        has_own = np.flatnonzero(own[active] >= 0)
        lower[has_own, own[active][has_own]] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        stay = upper >= kth[:, None]
        left = stay.sum(axis=1)
        done = left <= few * k
        for i in np.flatnonzero(done):
            out[active[i]] = np.flatnonzero(stay[i])
        active = active[~done]
    return out


def _exact(values: list[np.ndarray]) -> type:
    """The fastest number type in which every inner product of these integers is exact."""
    top = [float(np.abs(v).max()) if v.size else 0.0 for v in values]
    most = top[0] * top[1] * max(1, values[0].shape[1])
    return np.float32 if most < 2**24 else np.float64


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query id, vector id, score) of the k best of a block for each query."""
    kind = _exact([queries, vectors])
    q, v = queries.astype(kind), vectors.astype(kind)
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, query_ids, sorter=order), len(ids) - 1)
    own = np.where(ids[order[at]] == query_ids, order[at], -1)
    found = nra(q, v, own, k)
    whole = None
    for i, places in enumerate(found):
        if len(places) == len(v):
            if whole is None:
                rest = [j for j, p in enumerate(found) if len(p) == len(v)]
                whole = dict(zip(rest, q[rest] @ v.T))
            score = whole[i].astype(np.int64)
        else:
            score = (v[places] @ q[i]).astype(np.int64)
        if own[i] >= 0:
            keep = places != own[i]
            places, score = places[keep], score[keep]
        if len(score) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            places, score = places[score >= cut], score[score >= cut]
        best = np.lexsort((ids[places], -score))[:k]
        yield query_ids[i], ids[places[best]], score[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, ``id_col``, score): the ``k`` best partners of every row that meets ``is_query``, a condition on the id.

    Components are ``floor(scale * x)``, the score is their integer inner product, ties go to the smaller id, a row is no partner of
    itself.  Vectors that are null or hold a null, NaN or infinite component, and rows without an id, take no part.  Of several
    vectors of one id the greatest, component by component, stands.  A shorter vector counts as padded with zeros.  Fewer than
    ``k`` candidates: all of them.  Other columns are not read.  Empty table: no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = (vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(~odd)
             .select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")))
    one = materialise(whole.groupBy("id").agg(F.first("q").alias("q"), F.max("v").alias("v")), "vectors")
    size = one.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("q"), F.max(F.size("v")).alias("dim")).first()
    blocks, query_blocks, dim = max(1, math.ceil(size.n / BLOCK)), max(1, math.ceil((size.q or 0) / QUERIES)), size.dim or 0

    def packed(rows: DataFrame, parts: int, name: str) -> DataFrame:
        """One row per block: ids and components as binary."""
        def run(key: tuple, part: pa.Table) -> pa.Table:
            got = part.column("v").to_pylist()
            v = np.zeros((len(got), dim), np.int64)
            for i, c in enumerate(got):
                v[i, :len(c)] = c
            kind = np.int16 if not v.size or np.abs(v).max() < 2**15 else np.int64
            return pa.table({name: pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([part.column("id").to_numpy().tobytes()], pa.binary()),
                             "vectors": pa.array([v.astype(kind).tobytes()], pa.binary())})

        return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(run, f"{name} int, ids binary, vectors binary")

    def rows_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(part.column("ids")[0].as_py(), np.int64)
        raw = part.column("vectors")[0].as_py()
        return ids, np.frombuffer(raw, np.int16 if len(raw) == 2 * dim * len(ids) else np.int64).reshape(len(ids), dim)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(best_of_block(*rows_of(left), *rows_of(right), k)) if left.num_rows and right.num_rows else []
        n = [len(ids) for _, ids, _ in out]
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return pa.table({"query_id": np.repeat(np.array([q for q, _, _ in out], np.int64), n), "id": join([i for _, i, _ in out]), "score": join([s for _, _, s in out])})

    asking = packed(one.filter("q"), query_blocks, "qb").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = packed(one, blocks, "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    near = asking.groupBy("qb", "cb").cogroup(asked.groupBy("qb", "cb")).applyInArrow(meet, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
