"""Reports: JSON, SARIF, Markdown and the tables behind the HTML page.

A report is a table of text pieces ``(scan_id, part, ord, text)``.  Joining a scan's pieces in (part, ord) order
gives the document.  No document is ever assembled in one row or one task, so a scan may hold any share of all
findings; :func:`write_report` sorts by range and writes text files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from scanloom.functions.scalar import (
    SEVERITY_ICONS, UNKNOWN_ICON, lookup, or_default, patch_status, short_id, short_location,
)
from scanloom.schemas import SEVERITIES
from scanloom.session import materialise

# SARIF envelope and the analysis length shown in Markdown.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
ANALYSIS_CHARS = 500
TOOL_NAME, TOOL_VERSION = "scanloom", "1.0.0"
STANDARD_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SARIF_COLUMNS = ["rule_id", "rule_name", "message", "severity", "file_path", "line_start", "line_end", "column_start", "column_end", "confidence",
                 "cwe_id", "scanner", "ai_patch", "patch_validated"]

HEAD, ITEM, TAIL = 0, 1, 2
# Findings of a scan that meet in one task.
SCAN_ROWS = 4096


# ---------------------------------------------------------------- pieces

def finding_json(columns: list[str]) -> Column:
    """One finding as a JSON object; nulls are written, as in the original document."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def sarif_level(severity: Column, levels: str = "plain") -> Column:
    """Lower-cased severity, or ``note``; ``standard`` maps to the levels of the specification."""
    if levels == "standard":
        return lookup(severity, STANDARD_LEVELS, "note")
    return F.when(severity.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.lower(severity)).otherwise("note")


def sarif_result(levels: str = "plain") -> Column:
    c = F.col
    region = F.struct(c("line_start").alias("startLine"), c("line_end").alias("endLine"),
                      c("column_start").alias("startColumn"), c("column_end").alias("endColumn"))
    place = F.struct(F.struct(c("file_path").alias("uri")).alias("artifactLocation"), region.alias("region"))
    return F.to_json(F.struct(
        F.coalesce(F.nullif("rule_id", F.lit("")), "rule_name").alias("ruleId"),
        F.struct(c("message").alias("text")).alias("message"),
        sarif_level(c("severity"), levels).alias("level"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct(c("confidence"), c("cwe_id").alias("cwe"), c("scanner"), c("ai_patch").alias("aiPatch"),
                 c("patch_validated").alias("patchValidated")).alias("properties")), {"ignoreNullFields": "false"})


def markdown_block() -> Column:
    """Markdown of one finding."""
    c = F.col
    line = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in xs])
    analysis = F.when(F.coalesce("ai_analysis", F.lit("")) != "",
                      line("**AI Analysis**: ", F.substring("ai_analysis", 1, ANALYSIS_CHARS), "...")).otherwise("")
    patch = F.when(F.coalesce("ai_patch", F.lit("")) != "", line("**AI Patch**: \n```\n", c("ai_patch"), "\n```")).otherwise("")
    return line(
        "### ", c("rule_name"), "\n\n- **Severity**: `", c("severity"), "`\n- **Location**: `", c("file_path"), ":", c("line_start"),
        "`\n- **CWE**: ", or_default(c("cwe_id"), "N/A"), "\n- **Scanner**: ", c("scanner"),
        "\n\n**Vulnerable Code**:\n```\n", c("code_snippet"), "\n```\n\n", analysis, "\n\n", patch, "\n\n---\n")


def markdown_head(stats: DataFrame) -> DataFrame:
    """``(scan_id, text)``: title, summary and severity tables; ``stats`` has one row per scan."""
    rows = [F.concat(F.lit(f"| {SEVERITY_ICONS.get(s, UNKNOWN_ICON)} {s} | "), F.col(f"{s.lower()}_count").cast("string"), F.lit(" |\n"))
            for s in SEVERITIES]
    fact = lambda label, value: F.concat(F.lit(f"| **{label}** | "), value, F.lit(" |\n"))
    text = F.concat(
        F.lit("# 🔒 Security Scan Report\n\n## Scan Summary\n\n| Metric | Value |\n|--------|-------|\n"),
        fact("Target", F.concat(F.lit("`"), "target_path", F.lit("`"))), fact("Scan Time", F.col("scan_timestamp").cast("string")),
        fact("Duration", F.concat(F.format_string("%.1f", F.col("duration_seconds").cast("double")), F.lit("s"))),
        fact("Total Findings", F.col("total_findings").cast("string")), fact("Validated Patches", F.col("validated_patches").cast("string")),
        F.lit("\n## Severity Distribution\n\n| Severity | Count |\n|----------|-------|\n"), *rows, F.lit("\n## Findings\n\n"))
    return stats.select("scan_id", text.alias("text"))


# ---------------------------------------------------------------- documents

def _document(heads: DataFrame, findings: DataFrame, text: Column, tails: DataFrame | None, separator: str = "") -> DataFrame:
    """Pieces of all documents.  ``heads``/``tails`` = (scan_id, text); ``text`` is the item of a row of ``findings``.

    A separator goes in front of every item but a scan's first.
    """
    if separator:
        body = _separated(findings, text, separator)
    else:
        body = findings.select("scan_id", F.struct(F.lit(True).alias("late"), _item_order(findings).alias("ord"), F.lit(1).cast("bigint").alias("copy")).alias("ord"),
                               text.alias("text"))
    body = body.select("scan_id", F.lit(ITEM).alias("part"), "ord", "text")
    none = F.lit(None).cast(body.schema["ord"].dataType)
    out = heads.select("scan_id", F.lit(HEAD).alias("part"), none.alias("ord"), "text").unionByName(body)
    return out if tails is None else out.unionByName(tails.select("scan_id", F.lit(TAIL).alias("part"), none.alias("ord"), "text"))


def _separated(findings: DataFrame, text: Column, separator: str, scan_rows: int | None = None) -> DataFrame:
    """``(scan_id, ord, text)`` of every item.

    Findings are shuffled as rows, which are shorter than their texts, and only once: those of a scan with at most ``scan_rows`` meet
    and are numbered in order.  Larger scans never meet: their first items, one row a scan, are found by a map-side minimum over orders
    and digests and join them; only items equal to a first one are counted, so that one of the copies leads.
    """
    scan_rows = SCAN_ROWS if scan_rows is None else scan_rows
    large = materialise(findings.groupBy(F.col("scan_id").alias("large_id")).agg(F.count(F.lit(1)).alias("rows"))
                        .filter(F.col("rows") > scan_rows).select("large_id"), "large")
    is_large = F.col("scan_id").eqNullSafe(F.col("large_id"))
    if large.isEmpty():
        return _numbered(findings, text, separator)
    few, many = (findings.join(large, is_large, how) for how in ("left_anti", "left_semi"))
    return _numbered(few, text, separator).unionByName(_led(many, text, separator))


def _numbered(findings: DataFrame, text: Column, separator: str) -> DataFrame:
    """Items of scans that fit into a task: one shuffle by scan, ties in order of the other columns."""
    order = _order_names(findings)
    other = [f.name for f in findings.schema if f.name not in ("scan_id", *order) and not isinstance(f.dataType, MapType)]
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(*order, *other)).cast("bigint")
    late = F.col("place") > 1
    return findings.withColumn("place", place).select(
        "scan_id", F.struct(late.alias("late"), _item_order(findings).alias("ord"), F.col("place").alias("copy")).alias("ord"),
        F.concat(F.when(late, separator).otherwise(""), text).alias("text"))


def _led(findings: DataFrame, text: Column, separator: str) -> DataFrame:
    """Items of scans of any size: no text but those of first items is shuffled."""
    items = findings.select("scan_id", _item_order(findings).alias("ord"), text.alias("text")).withColumn("digest", F.md5("text"))
    first = materialise(items.groupBy(F.col("scan_id").alias("large_id")).agg(F.min(F.struct("ord", "digest")).alias("first")), "first")
    led = items.join(first, F.col("scan_id").eqNullSafe(F.col("large_id")), "left").withColumn("leads", F.struct("ord", "digest") == F.col("first"))
    row = lambda late, copy: F.struct(late.alias("late"), F.col("ord"), copy.cast("bigint").alias("copy")).alias("ord")
    late = led.filter(~F.col("leads")).select("scan_id", row(F.lit(True), F.lit(1)), F.concat(F.lit(separator), "text").alias("text"))
    equal = led.filter("leads").groupBy("scan_id", "ord").agg(F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text"))
    single = equal.select("*", F.explode_outer(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    return late.unionByName(single.select(
        "scan_id", row(F.col("copy") > 1, F.col("copy")), F.concat(F.when(F.col("copy") > 1, separator).otherwise(""), "text").alias("text")))


def _order_names(findings: DataFrame) -> list[str]:
    return [c for c in ("file_path", "line_start", "rule_id", "id") if c in findings.columns]


def _item_order(findings: DataFrame) -> Column:
    return F.struct(*_order_names(findings))


def report_json(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """JSON documents.  ``scans`` = (scan_id, target_path, scan_timestamp, duration_seconds, statistics JSON text)."""
    columns = [c for c in findings.columns if c != "scan_id"]
    js = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    value = lambda c: F.regexp_extract(js(c), r"(?s)^\{\"v\":(.*)\}$", 1)
    heads = scans.select("scan_id", F.concat(
        F.lit('{"target_path": '), value("target_path"), F.lit(', "scan_timestamp": '), value("scan_timestamp"),
        F.lit(', "findings": [')).alias("text"))
    tails = scans.select("scan_id", F.concat(
        F.lit('], "statistics": '), F.coalesce("statistics", F.lit("{}")), F.lit(', "duration_seconds": '),
        F.col("duration_seconds").cast("string"), F.lit("}")).alias("text"))
    return _document(heads, findings, finding_json(columns), tails, separator=", ")


def report_sarif(findings: DataFrame, scans: DataFrame, *, levels: str = "plain") -> DataFrame:
    used = findings.select("scan_id", *dict.fromkeys([*_order_names(findings), *SARIF_COLUMNS]))
    heads = scans.select("scan_id", F.lit(
        f'{{"$schema": "{SARIF_SCHEMA}", "version": "{SARIF_VERSION}", "runs": [{{"tool": {{"driver": '
        f'{{"name": "{TOOL_NAME}", "version": "{TOOL_VERSION}"}}}}, "results": [').alias("text"))
    return _document(heads, used, sarif_result(levels), scans.select("scan_id", F.lit("]}]}").alias("text")), separator=", ")


def report_markdown(findings: DataFrame, stats: DataFrame) -> DataFrame:
    return _document(markdown_head(stats), findings, markdown_block(), None)


def html_rows(findings: DataFrame) -> DataFrame:
    """The rows of the findings table on the HTML page."""
    return findings.select(
        *[c for c in ("scan_id",) if c in findings.columns], short_id(F.col("id")).alias("short_id"), "severity", "rule_name",
        short_location(F.col("file_path"), F.col("line_start")).alias("location"), or_default(F.col("cwe_id"), "N/A").alias("cwe"),
        patch_status(F.col("ai_patch"), F.col("patch_validated")).alias("patch_status"))


# ---------------------------------------------------------------- dispatch

Reporter = Callable[[DataFrame, DataFrame], DataFrame]
REPORTERS: dict[str, Reporter] = {
    "json": report_json, "sarif": report_sarif, "markdown": report_markdown,
    "html": lambda findings, scans: html_rows(findings),
}
# File suffix to format; any other suffix means JSON.
SUFFIXES = {"html": "html", "json": "json", "sarif": "sarif", "md": "markdown", "markdown": "markdown"}


def register_reporter(name: str, reporter: Reporter) -> None:
    REPORTERS[name.lower()] = reporter


def report(findings: DataFrame, scans: DataFrame, fmt: str = "html") -> DataFrame:
    """Report pieces in a format; an unknown format is an error."""
    if fmt.lower() not in REPORTERS:
        raise ValueError(f"Unsupported format: {fmt}")
    return REPORTERS[fmt.lower()](findings, scans)


def format_for(path: str) -> str:
    return SUFFIXES.get(path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else "", "json")


def write_report(pieces: DataFrame, path: str) -> None:
    """Write pieces as text, one folder per scan, files in document order."""
    (pieces.repartitionByRange("scan_id", "part", "ord").sortWithinPartitions("scan_id", "part", "ord")
     .select("scan_id", "text").write.mode("overwrite").partitionBy("scan_id").text(path))
