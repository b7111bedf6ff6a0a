"""What changed between two states of a source tree, and between two scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """``(path, hash)``: texts are hashed where they are read, so only 64 hex digits are ever shuffled."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def compare(base: DataFrame, head: DataFrame) -> DataFrame:
    """``(path, change)`` over two manifests: added, modified, deleted or same."""
    b, h = base.withColumnRenamed("hash", "base_hash"), head.withColumnRenamed("hash", "head_hash")
    change = (F.when(F.col("base_hash").isNull(), "added").when(F.col("head_hash").isNull(), "deleted")
              .when(F.col("base_hash") != F.col("head_hash"), "modified").otherwise("same"))
    return b.join(h, "path", "full_outer").select("path", change.alias("change"))


def changed_files(base: DataFrame, head: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Added or modified paths, plus staged ones that exist, each once."""
    changed = compare(base, head).filter(F.col("change").isin("added", "modified")).select("path")
    return changed if staged is None else union_changed(changed, staged.join(head, "path", "left_semi"))


def union_changed(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("path")
    for p in parts[1:]:
        out = out.unionByName(p.select("path"))
    return out.distinct()


def changed_stats(base: DataFrame, head: DataFrame, base_ref: str = "main", staged: DataFrame | None = None) -> DataFrame:
    """One row: the number of :func:`changed_files`, staged ones included, and counts of added, modified and deleted paths."""
    kind = lambda k: F.count_if(F.col("change") == k)
    seen = compare(base, head)
    if staged is None:
        seen = seen.withColumn("staged", F.lit(False))
    else:
        seen = seen.join(staged.select("path").distinct().withColumn("staged", F.lit(True)), "path", "left").withColumn("staged", F.coalesce("staged", F.lit(False)))
    wanted = F.col("change").isin("added", "modified") | (F.col("staged") & (F.col("change") != "deleted"))
    return seen.agg(
        F.lit(base_ref).alias("base_ref"), F.count_if(wanted).alias("files_changed"),
        kind("added").alias("added"), kind("modified").alias("modified"), kind("deleted").alias("deleted"))


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files worth scanning.  Semi join: texts of unchanged files are dropped at the join."""
    return files.join(changed.select("path"), "path", "left_semi")


def compare_scans(old: DataFrame, new: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Findings of two scans with ``status`` new, resolved or kept, one row per finding id."""
    keys = [key] if isinstance(key, str) else key
    seen = (old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n"))
            .unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
            .groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n")))
    status = F.when((F.col("o") == 1) & (F.col("n") == 1), "kept").when(F.col("n") == 1, "new").otherwise("resolved")
    return seen.select(*keys, status.alias("status"))


def line_diff(pairs: DataFrame, before: Column, after: Column, key: str) -> DataFrame:
    """Lines removed from and added to a text, as multisets: ``(key, line, removed, added)``.

    Both sides become +1/-1 counts that sum map-side; there is no join.
    """
    lines = lambda text, sign: F.transform(F.split(text, "\n", -1), lambda ln: F.struct(ln.alias("line"), F.lit(sign).alias("d")))
    return (pairs.select(key, F.inline(F.concat(lines(before, -1), lines(after, 1))))
            .groupBy(key, "line").agg(F.sum("d").alias("d")).filter("d <> 0")
            .select(key, "line", F.greatest(-F.col("d"), F.lit(0)).alias("removed"), F.greatest("d", F.lit(0)).alias("added")))
