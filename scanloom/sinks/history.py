"""Scan history and labels as Parquet tables that several runs write to.

A run writes its rows to folders of its own and then adds one line to a manifest, its commit: readers see the folders that the manifest
names, so a run that broke off is not seen, and a run of the same name replaces what it wrote before.  Small runs can be
compacted into one folder; rows carry their run, so a run can still be replaced afterwards.

Layout: ``root/<table>/folder=<f>/[scan_month=<m>/]`` and ``root/manifest/`` as JSON lines (seq, folder, kind, runs, tables).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from scanloom.operators.stats import scan_counts, scanner_results_json
from scanloom.schemas import FEEDBACK_COLUMNS, FINDING_HISTORY_COLUMNS, SCAN_HISTORY_COLUMNS

KINDS = {"history": ("scans", "findings"), "feedback": ("feedback",)}
_MANIFEST = "seq long, folder string, kind string, runs array<string>, rows long"


def scan_key(target: Column, timestamp: Column) -> Column:
    """Positive 63-bit scan id from target and time: no counter, so scans can be written in parallel."""
    return F.xxhash64(target, timestamp.cast("string")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def scan_rows(findings: DataFrame, scans: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """History row per scan.  ``scans`` = (scan_id, target_path, scan_timestamp, duration_seconds); scans without
    findings are kept with zeros."""
    counts = scan_counts(findings)
    if raw is not None:
        counts = counts.drop("scanner_results").join(scanner_results_json(raw), "scan_id", "full")
    out = scans.join(counts, "scan_id", "left")
    zero = [c for c in SCAN_HISTORY_COLUMNS if c.endswith("_count") or c in ("total_findings", "validated_patches")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("scanner_results", F.coalesce("scanner_results", F.lit("{}")))
    return out.select(*SCAN_HISTORY_COLUMNS)


def finding_rows(findings: DataFrame) -> DataFrame:
    """History row per finding; flags become 0/1."""
    return findings.withColumns({
        "cwe_id": F.coalesce("cwe_id", F.lit("")),
        "patch_generated": F.when(F.coalesce("ai_patch", F.lit("")) != "", 1).otherwise(0),
        "patch_validated": F.when(F.col("patch_validated"), 1).otherwise(0)}).select(*FINDING_HISTORY_COLUMNS)


def feedback_rows(findings: DataFrame, label: Column, key: str = "id") -> DataFrame:
    return findings.withColumn("finding_id", F.col(key)).withColumn("is_true_positive", label).select(*FEEDBACK_COLUMNS)


def record_scan(findings: DataFrame, scans: DataFrame, root: str, raw: DataFrame | None = None, run: str | None = None) -> None:
    """Write the rows of one run below ``root``, partitioned by month, with the day as a column.

    Rows are gathered by month and sorted by day; partitions are cut and joined by their size
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so quiet months have few files and a busy one as many as it needs, and a
    query for some days reads its months and skips the row groups of other days.  A run of the same name replaces what it wrote before:
    give a name where a step may be repeated.  Without one every call adds rows.  Findings whose scan is not in ``scans`` are left out.
    """
    when = scans.select("scan_id", F.to_date("scan_timestamp").alias("scan_date"))
    dated = finding_rows(findings).join(when, "scan_id").withColumn("scan_month", F.date_format("scan_date", "yyyy-MM"))
    _write(root, "history", run or uuid.uuid4().hex, {"scans": scan_rows(findings, scans, raw).select("*", *_days()), "findings": dated})


def record_feedback(findings: DataFrame, label: Column, root: str, key: str = "id", run: str | None = None) -> None:
    """Write the labels of one run; a run of the same name replaces what it wrote before, as in :func:`record_scan`."""
    _write(root, "feedback", run or uuid.uuid4().hex, {"feedback": feedback_rows(findings, label, key)})


def read_history(spark: SparkSession, root: str, table: str, since: str | None = None) -> DataFrame:
    """``scans``, ``findings`` or ``feedback`` of all committed runs; from the day ``since`` on, whose month prunes the folders.

    Raises ``ValueError`` where no run has been committed.
    """
    kind = next(k for k, tables in KINDS.items() if table in tables)
    owners = _owners(manifest(spark, root), kind).collect()  # one short line a run
    if not owners:
        raise ValueError(f"no committed run of {table} below {root}")
    rows = _read(spark, root, table, {r.folder: r.lost for r in owners})
    if since is None:
        return rows
    return rows.filter((F.col("scan_month") >= since[:7]) & (F.col("scan_date") >= F.lit(since).cast("date")))


def compact_history(spark: SparkSession, root: str, kind: str = "history", below: int = 1_000_000) -> int:
    """Write the runs of all folders with fewer than ``below`` rows into one folder; the number of folders that it replaces.

    Readers see the old folders until the new one is committed.  A compaction that broke off leaves everything as it was.
    """
    small = [r for r in _owners(manifest(spark, root), kind).collect() if r.rows < below]
    if len(small) < 2:
        return 0
    parts = {r.folder: r.lost for r in small}
    tables = {t: _read(spark, root, t, parts).drop("folder") for t in KINDS[kind]}
    _write(root, kind, None, tables, [x for r in small for x in r.kept])
    return len(small)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(seq, folder, kind, runs, rows), one row per commit; empty where nothing has been committed."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _days() -> list[Column]:
    return [F.to_date("scan_timestamp").alias("scan_date"), F.date_format("scan_timestamp", "yyyy-MM").alias("scan_month")]


def _write(root: str, kind: str, run: str | None, tables: dict[str, DataFrame], runs: list[str] | None = None) -> None:
    """Write the tables to a fresh folder and commit it for ``runs``, or for ``run`` alone, whose name the rows then get."""
    folder, rows = "f" + uuid.uuid4().hex, 0
    for name, table in tables.items():
        spark = table.sparkSession
        path = f"{root}/{name}/folder={folder}"
        monthly = "scan_month" in table.columns
        named = table.hint("rebalance", F.col("scan_month")).sortWithinPartitions("scan_month", "scan_date") if monthly else table.hint("rebalance")
        if run is not None:
            named = named.withColumn("run", F.lit(run))  # after the rows are dealt and sorted, so none of them carries it there
        writer = named.write.partitionBy("scan_month") if monthly else named.write
        writer.parquet(path)
        rows += spark.read.schema(named.schema).parquet(path).count()  # from the footers
    last = manifest(spark, root).agg(F.max("seq")).first()[0]
    line = [((last or 0) + 1, folder, kind, runs or [run], rows)]
    spark.createDataFrame(line, _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")


def _owners(commits: DataFrame, kind: str) -> DataFrame:
    """(folder, rows, kept, lost): the folders with a run that no later commit holds, and which of their runs one does."""
    each = commits.filter(F.col("kind") == kind).select("seq", "folder", "rows", F.explode("runs").alias("run"))
    last = each.groupBy("run").agg(F.max(F.struct("seq", "folder")).alias("last")).select("run", F.col("last.folder").alias("owner"))
    mine = F.col("owner") == F.col("folder")
    per = each.join(last, "run").groupBy("folder", "rows").agg(
        F.collect_list(F.when(mine, F.col("run"))).alias("kept"), F.collect_list(F.when(~mine, F.col("run"))).alias("lost"))
    return per.filter(F.size("kept") > 0).orderBy("folder")


def _read(spark: SparkSession, root: str, table: str, folders: dict[str, list[str]]) -> DataFrame:
    """The rows of ``folders``, each without its lost runs."""
    rows = spark.read.option("basePath", f"{root}/{table}").option("mergeSchema", "true").parquet(*[f"{root}/{table}/folder={f}" for f in folders])
    lost = [(f, run) for f, runs in folders.items() for run in runs]
    if not lost:
        return rows
    return rows.join(spark.createDataFrame(lost, "folder string, run string"), ["folder", "run"], "left_anti")


def with_scans(history: DataFrame, scans: DataFrame) -> DataFrame:
    """History findings with their scan."""
    return history.join(scans, "scan_id")


def orphans(history: DataFrame, scans: DataFrame) -> DataFrame:
    """History findings whose scan is missing."""
    return history.join(scans.select("scan_id"), "scan_id", "left_anti")
