"""Sinks: history rows and reports, checked field by field."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.scalar import finding_id
from scanloom.operators import stats
from scanloom.plans.queries.aggregations import SEV_SUMS
from scanloom.plans.registry import query
from scanloom.schemas import FEEDBACK_COLUMNS, FINDING_HISTORY_COLUMNS, SCAN_HISTORY_COLUMNS
from scanloom.session import run_dir
from scanloom.sinks import history, reports

ID = "substr(sha256(file_path || ':' || CAST(line_start AS STRING) || ':' || rule_id || ':' || code_snippet), 1, 16)"


def _findings(t):
    """Findings with what a report needs."""
    return t.findings.drop("target").withColumns({
        "id": finding_id(F.col("file_path"), F.col("line_start"), F.col("rule_id"), F.col("code_snippet")),
        "column_start": F.lit(1), "column_end": F.lit(2), "ai_analysis": F.col("message")})


def _recorded(t, table):
    root = run_dir(t.spark, "history")
    history.record_scan(t.findings, t.scan_heads, root)
    return history.read_history(t.spark, root, table)


@query("record_scan", f"""
    SELECT h.scan_id, h.target_path, strftime(h.scan_timestamp, '%Y-%m-%d') AS scan_day, round(h.duration_seconds, 6) AS duration_seconds, coalesce(c.total_findings, 0) AS total_findings,
      coalesce(c.critical_count, 0) AS critical_count, coalesce(c.high_count, 0) AS high_count, coalesce(c.medium_count, 0) AS medium_count, coalesce(c.low_count, 0) AS low_count,
      coalesce(c.info_count, 0) AS info_count, coalesce(c.validated_patches, 0) AS validated_patches, coalesce(j.scanner_results, '{{}}') AS scanner_results
    FROM v_scan_heads h LEFT JOIN (SELECT scan_id, CAST(count(*) AS BIGINT) AS total_findings, {SEV_SUMS}, CAST(count(*) FILTER (patch_validated) AS BIGINT) AS validated_patches FROM v_findings GROUP BY scan_id) c ON c.scan_id = h.scan_id
    LEFT JOIN (SELECT scan_id, '{{' || string_agg('"' || scanner || '":' || CAST(n AS STRING), ',' ORDER BY scanner) || '}}' AS scanner_results
      FROM (SELECT scan_id, scanner, count(*) AS n FROM v_findings GROUP BY scan_id, scanner) GROUP BY scan_id) j ON j.scan_id = h.scan_id""")
def record_scan(t):
    """Written, committed, and read back."""
    rows = _recorded(t, "scans").select(*SCAN_HISTORY_COLUMNS)
    return rows.withColumn("scan_day", F.date_format("scan_timestamp", "yyyy-MM-dd")).withColumn("duration_seconds", F.round("duration_seconds", 6)).drop("scan_timestamp")


@query("record_findings", """
    SELECT scan_id, rule_name, severity, cwe_id, file_path, CAST(CASE WHEN ai_patch <> '' THEN 1 ELSE 0 END AS BIGINT) AS patch_generated,
      CAST(CASE WHEN patch_validated THEN 1 ELSE 0 END AS BIGINT) AS patch_validated FROM v_findings""")
def record_findings(t):
    return _recorded(t, "findings").select(*FINDING_HISTORY_COLUMNS).withColumns({c: F.col(c).cast("long") for c in ("patch_generated", "patch_validated")})


@query("record_feedback", f"""
    SELECT {ID} AS finding_id, rule_name, severity, code_snippet, message, scanner, patch_validated AS is_true_positive FROM v_findings""")
def record_feedback(t):
    root = run_dir(t.spark, "history")
    history.record_feedback(_findings(t), F.col("patch_validated"), root)
    return history.read_history(t.spark, root, "feedback").select(*FEEDBACK_COLUMNS)


@query("report_json", f"""
    SELECT scan_id, {ID} AS id, severity, message, code_snippet, CAST(line_start AS BIGINT) AS line_start, CAST(rn > 1 AS BOOLEAN) AS has_comma FROM (
      SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY file_path, line_start, rule_id, {ID}) AS rn FROM v_findings)""")
def report_json(t):
    """The document pieces, read back field by field; exactly one finding per scan comes without a comma."""
    heads = t.scan_heads.withColumn("statistics", F.lit("{}"))
    items = reports.report_json(_findings(t), heads).filter(F.col("part") == reports.ITEM)
    late = F.col("text").startswith(", ")
    doc = F.when(late, F.substr("text", F.lit(3))).otherwise(F.col("text"))
    get = lambda k: F.get_json_object(doc, "$." + k)
    return items.select("scan_id", get("id").alias("id"), get("severity").alias("severity"), get("message").alias("message"), get("code_snippet").alias("code_snippet"),
                        get("line_start").cast("long").alias("line_start"), late.alias("has_comma"))


@query("report_sarif", f"""
    SELECT scan_id, rule_id, message, CASE WHEN severity = 'INFO' THEN 'note' ELSE lower(severity) END AS level, file_path AS uri, CAST(line_start AS BIGINT) AS start_line,
      CAST(line_end AS BIGINT) AS end_line, cwe_id AS cwe, CAST(patch_validated AS BOOLEAN) AS patch_validated FROM v_findings
    UNION ALL SELECT scan_id, '2.1.0', 'head', '', '', 0, 0, '', FALSE FROM v_scan_heads""")
def report_sarif(t):
    pieces = reports.report_sarif(_findings(t), t.scan_heads)
    items = pieces.filter(F.col("part") == reports.ITEM)
    doc = F.regexp_replace("text", "^, ", "")
    get = lambda k: F.get_json_object(doc, "$." + k)
    rows = items.select("scan_id", get("ruleId").alias("rule_id"), get("message.text").alias("message"), get("level").alias("level"),
                        get("locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
                        get("locations[0].physicalLocation.region.startLine").cast("long").alias("start_line"),
                        get("locations[0].physicalLocation.region.endLine").cast("long").alias("end_line"),
                        get("properties.cwe").alias("cwe"), (get("properties.patchValidated") == "true").alias("patch_validated"))
    version = F.regexp_extract("text", r'"version": "([\d.]+)"', 1)
    heads = pieces.filter(F.col("part") == reports.HEAD).select(
        "scan_id", version.alias("rule_id"), F.lit("head").alias("message"), F.lit("").alias("level"), F.lit("").alias("uri"), F.lit(0).cast("long").alias("start_line"),
        F.lit(0).cast("long").alias("end_line"), F.lit("").alias("cwe"), F.lit(False).alias("patch_validated"))
    return rows.unionByName(heads)


@query("report_markdown", """
    SELECT scan_id, md5(block) AS block_md5, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT scan_id, '### ' || rule_name || chr(10) || chr(10) || '- **Severity**: `' || severity || '`' || chr(10) || '- **Location**: `' || file_path || ':' || CAST(line_start AS STRING) || '`' || chr(10) ||
        '- **CWE**: ' || coalesce(nullif(cwe_id, ''), 'N/A') || chr(10) || '- **Scanner**: ' || scanner || chr(10) || chr(10) || '**Vulnerable Code**:' || chr(10) || '```' || chr(10) || code_snippet || chr(10) || '```' || chr(10) || chr(10) ||
        CASE WHEN message <> '' THEN '**AI Analysis**: ' || substr(message, 1, 500) || '...' ELSE '' END || chr(10) || chr(10) ||
        CASE WHEN ai_patch <> '' THEN '**AI Patch**: ' || chr(10) || '```' || chr(10) || ai_patch || chr(10) || '```' ELSE '' END || chr(10) || chr(10) || '---' || chr(10) AS block FROM v_findings) GROUP BY scan_id, md5(block)""")
def report_markdown(t):
    """Digest and number of every block of each scan."""
    by_scan = stats.scan_statistics(t.findings).join(t.scan_heads, "scan_id")
    items = reports.report_markdown(_findings(t), by_scan).filter(F.col("part") == reports.ITEM)
    return items.groupBy("scan_id", F.md5("text").alias("block_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("report_json_ends", """
    SELECT scan_id, target_path, strftime(scan_timestamp, '%Y-%m-%d') AS day, round(duration_seconds, 6)::DOUBLE AS duration_seconds, CAST(scan_id % 7 AS BIGINT) AS total, CAST(0 AS BIGINT) AS items
    FROM v_scan_heads""")
def report_json_ends(t):
    """Head and tail of every document, which together are a document without findings."""
    heads = t.scan_heads.withColumn("statistics", F.to_json(F.struct((F.col("scan_id") % 7).alias("total"))))
    ends = reports.report_json(_findings(t), heads).filter(F.col("part") != reports.ITEM)
    docs = ends.groupBy("scan_id").agg(F.concat(F.max(F.when(F.col("part") == reports.HEAD, F.col("text"))), F.max(F.when(F.col("part") == reports.TAIL, F.col("text")))).alias("doc"))
    get = lambda k: F.get_json_object("doc", "$." + k)
    return docs.select("scan_id", get("target_path").alias("target_path"), F.substring(get("scan_timestamp"), 1, 10).alias("day"),
                       F.round(get("duration_seconds").cast("double"), 6).alias("duration_seconds"), get("statistics.total").cast("long").alias("total"),
                       F.json_array_length(get("findings")).cast("long").alias("items"))


@query("report_sarif_ends", """
    SELECT scan_id, '2.1.0' AS version, 'scanloom' AS tool, CAST(1 AS BIGINT) AS runs, CAST(0 AS BIGINT) AS items FROM v_scan_heads""")
def report_sarif_ends(t):
    ends = reports.report_sarif(_findings(t), t.scan_heads).filter(F.col("part") != reports.ITEM)
    docs = ends.groupBy("scan_id").agg(F.concat(F.max(F.when(F.col("part") == reports.HEAD, F.col("text"))), F.max(F.when(F.col("part") == reports.TAIL, F.col("text")))).alias("doc"))
    get = lambda k: F.get_json_object("doc", "$." + k)
    return docs.select("scan_id", get("version").alias("version"), get("runs[0].tool.driver.name").alias("tool"), F.json_array_length(get("runs")).cast("long").alias("runs"),
                       F.json_array_length(get("runs[0].results")).cast("long").alias("items"))


@query("report_markdown_head", f"""
    SELECT h.scan_id, target_path, strftime(scan_timestamp, '%Y-%m-%d') AS day, total_findings, critical_count, high_count, medium_count, low_count, info_count, validated_patches
    FROM v_scan_heads h JOIN (SELECT scan_id, CAST(count(*) AS BIGINT) AS total_findings, {SEV_SUMS}, CAST(count(*) FILTER (patch_validated) AS BIGINT) AS validated_patches
      FROM v_findings GROUP BY scan_id) c ON c.scan_id = h.scan_id""")
def report_markdown_head(t):
    """The summary and the severity table, read back from the text."""
    by_scan = stats.scan_statistics(t.findings).join(t.scan_heads, "scan_id")
    heads = reports.report_markdown(_findings(t), by_scan).filter(F.col("part") == reports.HEAD)
    count = lambda name: F.regexp_extract("text", r"\| \S+ " + name + r" \| (\d+) \|", 1).cast("long")
    return heads.select("scan_id", F.regexp_extract("text", "Target\\*\\* \\| `([^`]*)`", 1).alias("target_path"), F.substring(F.regexp_extract("text", r"Scan Time\*\* \| ([^|]*) \|", 1), 1, 10).alias("day"),
                        F.regexp_extract("text", r"Total Findings\*\* \| (\d+) \|", 1).cast("long").alias("total_findings"),
                        *[count(s).alias(s.lower() + "_count") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")],
                        F.regexp_extract("text", r"Validated Patches\*\* \| (\d+) \|", 1).cast("long").alias("validated_patches"))


@query("html_tables", f"""
    SELECT scan_id, substr({ID}, 1, 8) AS short_id, severity, rule_name, split_part(file_path, '/', 3) || ':' || CAST(line_start AS STRING) AS location, coalesce(nullif(cwe_id, ''), 'N/A') AS cwe,
      CASE WHEN ai_patch = '' THEN 'No Patch' WHEN patch_validated THEN 'Validated' ELSE 'Unvalidated' END AS patch_status FROM v_findings""")
def html_tables(t):
    return reports.html_rows(_findings(t))


@query("report_dispatch", """
    SELECT 'html' AS fmt, CAST(count(*) AS BIGINT) AS pieces FROM v_findings
    UNION ALL SELECT 'json', CAST((SELECT count(*) FROM v_findings) + 2 * (SELECT count(*) FROM v_scan_heads) AS BIGINT)
    UNION ALL SELECT 'sarif', CAST((SELECT count(*) FROM v_findings) + 2 * (SELECT count(*) FROM v_scan_heads) AS BIGINT)
    UNION ALL SELECT 'markdown', CAST((SELECT count(*) FROM v_findings) + (SELECT count(DISTINCT scan_id) FROM v_findings) AS BIGINT)""")
def report_dispatch(t):
    """Every format by name, with the number of pieces it writes."""
    heads = t.scan_heads.withColumn("statistics", F.lit("{}"))
    by_scan = stats.scan_statistics(t.findings).join(t.scan_heads, "scan_id")
    out = None
    for fmt in ("html", "json", "sarif", "markdown"):
        pieces = reports.report(_findings(t), by_scan if fmt == "markdown" else heads, fmt)
        n = pieces.agg(F.lit(fmt).alias("fmt"), F.count(F.lit(1)).alias("pieces"))
        out = n if out is None else out.unionByName(n)
    return out
