"""Hard negatives by anchor spanning trees.

Anchors are dealt into blocks; in a block they form a minimum spanning tree.  A block meets every block of candidates once.  The
root's scores are products; for a child, a candidate's score lies within the parent's score plus or minus the edge's length
times the candidate's norm (Cauchy-Schwarz), and an interval that was never resolved widens from edge to edge.  Only candidates
whose interval may matter are scored again: those that may be among the first positives, or that reach a window of negatives.

Two rounds: the positives of every anchor come first, because their scores set the windows.  A meeting holds one block of anchors
and one of candidates and gives a few rows an anchor, so memory is bounded and a hot label is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.tables import materialise, ship_package

#: Anchors and candidates of a block, and candidates that are scored at a time.
ANCHORS, BLOCK, SLICE = 1024, 16384, 2048
#: Above this share of a level's pairs, a product over all of them is cheaper than single ones.
DENSE = 0.05


def spanning_tree(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of a minimum spanning tree from point 0: (points, place of each one's parent in the level before, edge lengths)."""
    n = len(points)
    if not n:
        return
    parent, level = np.zeros(n, np.int64), np.zeros(n, np.int64)
    near = np.full(n, np.inf)
    out, at = np.ones(n, bool), 0
    for _ in range(n - 1):
        out[at] = False
        gap = ((points - points[at]) ** 2).sum(axis=1)
        closer = out & (gap < near)
        near[closer], parent[closer] = gap[closer], at
        at = int(np.argmin(np.where(out, near, np.inf)))
        level[at] = level[parent[at]] + 1
    place = np.zeros(n, np.int64)
    for depth in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level == depth)
        place[nodes] = np.arange(len(nodes))
        yield nodes, place[parent[nodes]], np.sqrt(near[nodes]) * (1 + 1e-9) if depth else np.zeros(1)


class Scores:
    """Inner products of integer vectors, exact, as float64 below 2**53 and as int64 below 2**63; larger ones are an error."""

    def __init__(self, anchors: np.ndarray, vectors: np.ndarray):
        top = [int(np.abs(v).max(initial=0)) for v in (anchors, vectors)]
        most = top[0] * top[1] * max(1, anchors.shape[1])
        if most >= 2**63:
            raise OverflowError("a score does not fit a long")
        kind = np.float64 if most < 2**53 else np.int64
        self.slack = 0.0 if most < 2**53 else most * 2.0**-50
        self.a, self.v = anchors.astype(kind), vectors.astype(kind)
        self.norms = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)

    def of(self, nodes: np.ndarray, columns: slice, mask: np.ndarray) -> np.ndarray:
        """Scores where ``mask`` says so; elsewhere anything."""
        v = self.v[columns]
        if mask.mean() > DENSE:
            return self.a[nodes] @ v.T
        out = np.zeros(mask.shape, self.a.dtype)
        i, j = np.nonzero(mask)
        for s in range(0, len(i), 1 << 16):
            out[i[s:s + (1 << 16)], j[s:s + (1 << 16)]] = (self.a[nodes[i[s:s + (1 << 16)]]] * v[j[s:s + (1 << 16)]]).sum(axis=1)
        return out


def walk(scores: Scores, levels: list, columns: slice, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
    """Down the tree: (anchors of a level, which pairs were scored, scores).  ``wanted(anchors, low, high)`` picks the pairs to score."""
    norms = scores.norms[columns]
    low = high = np.zeros((0, len(norms)))
    for depth, (nodes, parents, edges) in enumerate(levels):
        if depth:
            reach = edges[:, None] * norms + scores.slack
            low, high = low[parents] - reach, high[parents] + reach
            mask = wanted(nodes, low, high)
        else:
            low, high = np.empty((1, len(norms))), np.empty((1, len(norms)))
            mask = np.ones((1, len(norms)), bool)
        exact = scores.of(nodes, columns, mask)
        low, high = np.where(mask, exact, low), np.where(mask, exact, high)
        yield nodes, mask, exact


def first_positives(ids, labels, anchors, other_ids, other_labels, vectors, k: int):
    """(anchor, candidate id, score) of the ``k`` best candidates of its label, for each anchor of a block."""
    for label in np.intersect1d(labels, other_labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(other_labels == label)
        scores, their_ids = Scores(anchors[mine], vectors[theirs]), other_ids[theirs]
        levels = list(spanning_tree(scores.a.astype(np.float64)))
        kept: dict[int, list] = {}
        for s in range(0, len(theirs), SLICE):
            columns = slice(s, s + SLICE)
            own = lambda nodes: their_ids[columns] == ids[mine[nodes]][:, None]  # noqa: B023, E731

            def wanted(nodes, low, high):
                if low.shape[1] <= k + 1:
                    return np.ones(low.shape, bool)
                known = np.where(own(nodes), -np.inf, low)  # noqa: B023
                return high >= np.partition(known, low.shape[1] - k, axis=1)[:, [low.shape[1] - k]]

            for nodes, mask, exact in walk(scores, levels, columns, wanted):
                mask = mask & ~own(nodes)
                value = np.where(mask, exact, -np.inf)
                cut = np.partition(value, value.shape[1] - k, axis=1)[:, [value.shape[1] - k]] if value.shape[1] > k else -np.inf
                i, j = np.nonzero(mask & (value >= cut))
                for a, c, x in zip(nodes[i], j, exact[i, j]):
                    kept.setdefault(int(a), []).append((-int(x), int(their_ids[s + c])))
        for a, found in kept.items():
            for x, i in sorted(found)[:k]:
                yield int(ids[mine[a]]), i, -x


def window_negatives(ids, labels, anchors, positives: list[list[tuple[int, int]]], other_ids, other_labels, vectors, k: int, low_percent: int, high_percent: int):
    """(anchor, positive id, positive score, candidate id, score): per positive the ``k`` best candidates of another label in its window.

    The window of a positive: from ``low_percent`` to ``high_percent`` hundredths of its score, as exact integers.
    """
    bounds = [[(-(-low_percent * s // 100), high_percent * s // 100) for _, s in p] for p in positives]
    least = np.array([min((lo for lo, hi in b if lo <= hi), default=math.inf) for b in bounds], float)
    most = np.array([max((hi for lo, hi in b if lo <= hi), default=-math.inf) for b in bounds], float)
    scores = Scores(anchors, vectors)
    levels = list(spanning_tree(scores.a.astype(np.float64)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(vectors), SLICE):
        columns = slice(s, s + SLICE)

        def wanted(nodes, low, high):
            return (high >= least[nodes, None]) & (low <= most[nodes, None]) & (other_labels[columns] != labels[nodes][:, None])  # noqa: B023

        for nodes, mask, exact in walk(scores, levels, columns, wanted):
            inside = mask & (exact >= least[nodes, None]) & (exact <= most[nodes, None]) & (other_labels[columns] != labels[nodes][:, None])
            i, j = np.nonzero(inside)
            found.append((nodes[i], s + j, exact[i, j].astype(np.int64)))
    who, which, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
    order = np.lexsort((other_ids[which], -score, who))
    who, which, score = who[order], which[order], score[order]
    starts = np.searchsorted(who, np.arange(len(ids) + 1))
    for a, own in enumerate(positives):
        part, places = score[starts[a]:starts[a + 1]], which[starts[a]:starts[a + 1]]
        if not len(part):
            continue
        for (pid, ps), (lo, hi) in zip(own, bounds[a]):
            at = int(np.searchsorted(-part, -hi))
            for x, c in zip(part[at:at + k].tolist(), places[at:at + k]):
                if x < lo:
                    break
                yield int(ids[a]), pid, ps, int(other_ids[c]), x


def mine(vectors: DataFrame, is_anchor: Column, *, label: Column | None = None, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
         scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are ``floor(scale * x)``, scores their integer inner products with the anchor; higher scores first, ties by smaller
    id.  ``is_anchor`` is a condition on the id, ``label`` replaces the label column.  An anchor's positives are its first other rows
    of its label; for each, the first rows of another label whose score lies in the window are returned.  Rows with a null id,
    label or vector, or with a null, NaN or infinite component, take no part.  Of several rows of one id the greatest (label,
    vector) stands.  A shorter vector counts as padded with zeros.  Fewer positives or negatives: all there are; none: no row.  Other columns
    are not read.  Empty table: no rows.  A score beyond a long is an error.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x, own_label = F.col(vector_col), F.col(label_col) if label is None else label
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = (vectors.filter(F.col(id_col).isNotNull() & own_label.isNotNull() & x.isNotNull()).filter(~odd)
             .select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_anchor, F.lit(False)).alias("a"),
                     F.struct(own_label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")).alias("row")))
    one = materialise(whole.groupBy("id").agg(F.first("a").alias("a"), F.max("row").alias("row")).select("id", "a", "row.label", "row.v"), "labelled")
    size = one.agg(F.count("*").alias("n"), F.count_if("a").alias("a"), F.max(F.size("v")).alias("dim")).first()
    blocks, anchor_blocks, dim = max(1, math.ceil(size.n / BLOCK)), max(1, math.ceil(size.a / ANCHORS)), size.dim or 0
    binary = "ids binary, labels binary, vectors binary"

    def packed(rows: DataFrame, parts: int, name: str, extra: bool = False) -> DataFrame:
        """One row per block: ids, labels and components as binary, with ``extra`` the positives too."""
        def run(key: tuple, part: pa.Table) -> pa.Table:
            got = part.column("v").to_pylist()
            v = np.zeros((len(got), dim), np.int64)
            for i, c in enumerate(got):
                v[i, :len(c)] = c
            kind = np.int16 if not v.size or np.abs(v).max() < 2**15 else np.int64
            cells = {name: pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([part.column("id").to_numpy().tobytes()], pa.binary()),
                     "labels": pa.array([part.column("label").to_numpy().tobytes()], pa.binary()), "vectors": pa.array([v.astype(kind).tobytes()], pa.binary())}
            if extra:
                cells["positives"] = pa.array([part.column("positives").to_pylist()], pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))))
            return pa.table(cells)

        keyed = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        return keyed.groupBy("part").applyInArrow(run, f"{name} int, {binary}" + (", positives array<array<struct<id:long,score:long>>>" if extra else ""))

    def rows_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, labels = (np.frombuffer(part.column(c)[0].as_py(), np.int64) for c in ("ids", "labels"))
        raw = part.column("vectors")[0].as_py()
        return ids, labels, np.frombuffer(raw, np.int16 if len(raw) == 2 * dim * len(ids) else np.int64).reshape(len(ids), dim).astype(np.int64)

    def longs(found: list[tuple], names: list[str]) -> pa.Table:
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(names)})

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(first_positives(*rows_of(left), *rows_of(right), positives)) if left.num_rows and right.num_rows else []
        return longs(found, ["anchor_id", "positive_id", "positive_score"])

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            pos = [[(p["id"], p["score"]) for p in row] for row in left.column("positives")[0].as_py()]
            found = list(window_negatives(*rows_of(left), pos, *rows_of(right), negatives, low_percent, high_percent))
        return longs(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    stored = materialise(packed(one, blocks, "cb"), "blocks")

    def met(anchors: DataFrame, fn: Callable, schema: str) -> DataFrame:
        asking = anchors.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = stored.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
        return asking.groupBy("qb", "cb").cogroup(asked.groupBy("qb", "cb")).applyInArrow(fn, schema)

    def ranked(df: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), other))
        return df.withColumn("rank", place).filter(F.col("rank") <= most)

    anchors = one.filter("a")
    found = ranked(met(packed(anchors, anchor_blocks, "qb"), near, "anchor_id long, positive_id long, positive_score long"), ["anchor_id"], "positive_score", "positive_id", positives)
    best = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    informed = materialise(packed(anchors.join(best, "id"), anchor_blocks, "qb", extra=True), "anchors")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    return ranked(met(informed, hard, schema), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
