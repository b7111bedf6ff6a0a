"""Scan history: trends, top weaknesses, fix rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.scalar import severity_rank
from scanloom.session import materialise

# A last total below 0.8x the first is improving, above 1.2x worsening.
IMPROVING, WORSENING = 0.8, 1.2


def in_window(scans: DataFrame, as_of: str, days: int, ts: str = "scan_ts") -> DataFrame:
    """Scans of the last ``days`` days; literal bounds, so they push to Parquet and prune date partitions."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return scans.filter(F.col(ts) >= since.cast(scans.schema[ts].dataType))


def direction(first: Column, last: Column) -> Column:
    return F.when(last < first * IMPROVING, "improving").when(last > first * WORSENING, "worsening").otherwise("stable")


def trend_summary(scans: DataFrame, as_of: str, days: int = 30, ts: str = "scan_ts") -> DataFrame:
    """One row for the period: scans, direction, average, sums, patch rate; ``no_data`` when empty.

    A single aggregate with map-side partials; only its one row reaches a single task.
    """
    at = F.struct(ts, "scan_id")
    agg = in_window(scans, as_of, days, ts).agg(
        F.count(F.lit(1)).alias("scans"),
        F.min_by("total_findings", at).alias("first_total"), F.max_by("total_findings", at).alias("last_total"),
        F.avg("total_findings").alias("avg_findings_per_scan"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("total_critical"),
        F.coalesce(F.sum("high_count"), F.lit(0)).alias("total_high"),
        (F.sum("validated_patches") / F.greatest(F.sum("total_findings"), F.lit(1))).alias("patch_success_rate"))
    return agg.select(
        F.lit(days).alias("period_days"), "scans",
        F.when(F.col("scans") == 0, "no_data").otherwise(direction(F.col("first_total"), F.col("last_total"))).alias("trend_direction"),
        "avg_findings_per_scan", "total_critical", "total_high", "patch_success_rate")


def first_last(scans: DataFrame, by: str = "target", ts: str = "scan_ts") -> DataFrame:
    at = F.struct(ts, "scan_id")
    return scans.groupBy(by).agg(
        F.min_by("scan_id", at).alias("first_scan"), F.max_by("scan_id", at).alias("last_scan"),
        F.min_by("total_findings", at).alias("first_total"), F.max_by("total_findings", at).alias("last_total"))


def timeline(scans: DataFrame, ts: str = "scan_ts") -> DataFrame:
    """Scans by time: four fields, range-partitioned sort."""
    return scans.orderBy(ts, "scan_id").select(
        F.col(ts).alias("timestamp"), F.col("total_findings").alias("total"),
        F.col("critical_count").alias("critical"), F.col("high_count").alias("high"))


def trend_series(scans: DataFrame, as_of: str, days: int = 90, ts: str = "scan_ts") -> DataFrame:
    """Chart data: day, total, critical."""
    return (in_window(scans, as_of, days, ts).orderBy(ts, "scan_id")
            .select(F.substring(F.col(ts).cast("string"), 1, 10).alias("date"),
                    F.col("total_findings").alias("total"), F.col("critical_count").alias("critical")))


def top_cwe(history: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent weaknesses with the highest severity seen; ties by id."""
    return (history.filter(F.col("cwe_id") != "").groupBy("cwe_id")
            .agg(F.count(F.lit(1)).alias("count"), F.max(F.struct(severity_rank(F.col("severity")).alias("r"), "severity"))["severity"].alias("severity"))
            .orderBy(F.desc("count"), "cwe_id").limit(limit))


def fix_rate_by_severity(history: DataFrame) -> DataFrame:
    one = F.lit(1)
    return (history.groupBy("severity")
            .agg(F.sum("patch_generated").alias("g"), F.sum("patch_validated").alias("v"), F.count(one).alias("total"))
            .select("severity", (F.col("g") / F.greatest("total", one)).alias("patch_rate"),
                    (F.col("v") / F.greatest("g", one)).alias("validation_rate"), "total"))


def recent_history(scans: DataFrame, by: str = "target", limit: int = 5, ts: str = "scan_ts") -> DataFrame:
    """Newest scans of each group.  The rank limit is applied map-side too, so a busy group ships few rows."""
    w = Window.partitionBy(by).orderBy(F.desc(ts), F.desc("scan_id"))
    return scans.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def scan_sequence(scans: DataFrame, ts: str = "scan_ts") -> DataFrame:
    """1-based scan numbers in (time, target, id) order, without one task seeing all scans.

    Scans are range-partitioned by the full order (its unique tail keeps ranges even when many share a time) and
    kept as a table; a number is the rank inside the range plus the sizes of the ranges before it.
    """
    order = [ts, "target", "scan_id"]
    ranged = materialise(scans.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    # One row per range: a running sum over as many rows as there are shuffle partitions.
    before = (ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("size"))
              .withColumn("before", F.coalesce(F.sum("size").over(
                  Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size"))
    local = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return (ranged.withColumn("local", local).join(before, "range_no")
            .withColumn("seq", F.col("before") + F.col("local")).drop("range_no", "local", "before"))
