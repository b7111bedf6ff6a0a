"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.tables import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it sees."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and 128-bit sum of hashes of a set of edges; equal sets have equal ones."""
    hashed = (F.sum(F.xxhash64("a", "b", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2))
    return tuple(edges.agg(F.count("*"), *hashed).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node that has an edge, and the smallest node reachable from it.

    ``edges`` has columns ``a`` and ``b``; direction, repeats and loops do not matter, nulls are no nodes.  Every round is
    written to the shared folder, so that a lost executor costs one round.  Rounds grow with the logarithm of the longest
    chain; a hot node is only ever a group key of partial minima and one side of a join, which Spark splits.  No edges: no rows.
    """
    now = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = _fingerprint(now)
    while True:
        now = materialise(_small_star(_large_star(now)), "edges")
        before, seen = seen, _fingerprint(now)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
