"""Counts over findings.

Every statistic starts from one small cube, counted map-side: findings per (scan, severity, scanner,
weakness).  Later steps only see cube rows, so a scan holding a third of all findings costs no more
than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.schemas import SEVERITIES

SERIOUS = ["CRITICAL", "HIGH"]
TOP_CWES = 10


def _rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _where(cond: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))


def finding_cube(findings: DataFrame, by: tuple[str, ...] = (), names: tuple[str, ...] = ("scanner", "cwe_id")) -> DataFrame:
    own = [F.coalesce(c, F.lit("")).alias(c) if c == "cwe_id" else F.col(c) for c in names]
    return findings.groupBy(*by, "severity", *own).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("patch_validated").alias("n_validated"))


def severity_distribution(findings: DataFrame) -> DataFrame:
    """All five severities, zero where none."""
    counted = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    wanted = findings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("severity"))
    return wanted.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def count_by(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def cwe_counts(findings: DataFrame, limit: int = TOP_CWES) -> DataFrame:
    """The most frequent weaknesses, empty ones left out; ties by id."""
    return (findings.filter(F.col("cwe_id") != "").groupBy("cwe_id").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "cwe_id").limit(limit))


def patch_success(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return findings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_findings"), F.count_if("patch_validated").alias("validated_patches")
    ).withColumn("patch_success_rate", _rate(F.col("validated_patches"), F.col("total_findings")))


def serious_count(findings: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    return findings.groupBy(*by).agg(F.count_if(F.col("severity").isin(SERIOUS)).alias("critical_high"))


def gate(findings: DataFrame, by: tuple[str, ...] = ("scan_id",), *, fail_on_high: bool = True) -> DataFrame:
    """Per scan: does it fail the gate?"""
    return serious_count(findings, by).withColumn("fails", (F.col("critical_high") > 0) & F.lit(fail_on_high))


def _counted(findings: DataFrame, by: tuple[str, ...], names: tuple[str, ...] = ("scanner", "cwe_id")) -> DataFrame:
    """Per ``by``: total, the five severities, validated patches, and ``cells``, the rows of the cube by ``names`` that they were summed from.

    A scan has as many cells as it has kinds of findings, however many findings there are, and each cell is sent once.
    """
    severity, n = F.col("severity"), F.col("n")
    return finding_cube(findings, by, names).groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"), *[_where(severity == s, n).alias(f"{s.lower()}_count") for s in SEVERITIES],
        F.coalesce(F.sum("n_validated"), F.lit(0)).alias("validated_patches"), F.collect_list(F.struct(*names, "n")).alias("cells"))


def _summed(cells: Column, name: str) -> Column:
    """Array of (name, n), in the order of the names: the cells summed by one of their columns.

    The cells are sorted by that column and folded, so the cost is that of the sort.
    """
    named = F.sort_array(F.transform(cells, lambda c: F.struct(c[name].alias("name"), c["n"].alias("n"))))
    none = F.array().cast("array<struct<name: string, n: bigint>>")
    start = F.struct(none.alias("done"), F.lit(None).cast("struct<name: string, n: bigint>").alias("open"))

    def step(acc: Column, c: Column) -> Column:
        same = acc["open"].isNotNull() & acc["open"]["name"].eqNullSafe(c["name"])
        return F.struct(
            F.when(same | acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
            F.when(same, F.struct(c["name"].alias("name"), (acc["open"]["n"] + c["n"]).alias("n"))).otherwise(c).alias("open"))

    return F.aggregate(named, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))


def scan_statistics(findings: DataFrame, raw: DataFrame | None = None, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Per scan: total, the five severities, validated patches and rate, counts per scanner, top weaknesses, and
    (with ``raw``) counts per scanner before fusion.  Count lists are 'name=n' joined by commas.

    The findings are read once: everything follows from one cube.
    """
    cells = F.col("cells")
    named = F.filter(_summed(cells, "cwe_id"), lambda e: e["name"] != "")
    best = F.slice(F.array_sort(F.transform(named, lambda e: F.struct((-e["n"]).alias("o"), e["name"].alias("name"), e["n"].alias("n")))), 1, TOP_CWES)
    out = _counted(findings, by).select(
        "*", _listed(_summed(cells, "scanner")).alias("scanner_distribution"), _listed(best).alias("top_cwes")).drop("cells")
    out = out.withColumn("patch_success_rate", _rate(F.col("validated_patches"), F.col("total_findings")))
    if raw is not None:
        out = out.join(raw_scanner_counts(raw, by), list(by), "left")
    return out


def scan_counts(findings: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Per scan: total, the five severities, validated patches, and ``scanner_results`` as one JSON object; one read."""
    named = F.filter(_summed(F.col("cells"), "scanner"), lambda e: e["name"].isNotNull())
    return _counted(findings, by, ("scanner",)).withColumn("scanner_results", F.to_json(F.map_from_entries(named))).drop("cells")


def _listed(entries: Column) -> Column:
    """'name=n,...' of an array of entries."""
    return F.array_join(F.transform(entries, lambda e: F.concat(e["name"], F.lit("="), e["n"].cast("string"))), ",")


def count_list(entry: Column) -> Column:
    """Aggregate of (order, name, n) structs to 'name=n,...'; nulls are skipped."""
    return _listed(F.sort_array(F.collect_list(entry)))


def raw_scanner_counts(raw: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    counted = raw.groupBy(*by, "scanner").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(count_list(F.struct(F.lit(0).alias("o"), F.col("scanner").alias("name"), "n")).alias("raw_scanner_results"))


def scanner_results_json(raw: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Counts per scanner before fusion as one JSON object per scan, keys sorted."""
    counted = raw.groupBy(*by, "scanner").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("scanner", "n"))))).alias("scanner_results"))


def top_per_group(findings: DataFrame, group: str = "target", limit: int = TOP_CWES) -> DataFrame:
    """The most frequent weaknesses of every group.  Counting first leaves few rows to rank."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), "cwe_id")
    return (findings.filter(F.col("cwe_id") != "").groupBy(group, "cwe_id").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit))


def first_findings(findings: DataFrame, order: list[str], limit: int = 5) -> DataFrame:
    return findings.orderBy(*order).limit(limit)
