"""Ordered operators: context, functions, imports, history order."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import context, repair, trends
from scanloom.plans.registry import query
from scanloom.sources.files import source_lines


@query("line_context", """
    SELECT path, CAST(line_no AS BIGINT) AS line_no, md5(coalesce(string_agg(text, chr(10)) OVER b, '') || CASE WHEN line_no > 1 THEN chr(10) ELSE '' END) AS before_md5,
      md5(coalesce(string_agg(text, chr(10)) OVER a, '') || CASE WHEN line_no + 5 < count(*) OVER (PARTITION BY path) THEN chr(10) ELSE '' END) AS after_md5 FROM o_py_lines
    WINDOW b AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def line_context(t):
    return context.line_context(t.py_files).select("path", F.col("line_no").cast("long").alias("line_no"),
                                                   F.md5("context_before").alias("before_md5"), F.md5("context_after").alias("after_md5"))


@query("line_context_window", """
    SELECT path, CAST(line_no AS BIGINT) AS line_no, md5(coalesce(string_agg(text, chr(10)) OVER b, '')) AS before_md5, md5(coalesce(string_agg(text, chr(10)) OVER a, '')) AS after_md5 FROM o_py_lines
    WINDOW b AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def line_context_window(t):
    return (context.window_context(source_lines(t.py_files))
            .select("path", F.col("line_no").cast("long").alias("line_no"), F.md5("context_before").alias("before_md5"), F.md5("context_after").alias("after_md5")))


MARKS = r"""
    SELECT path, line_no, text, length(text) - length(ltrim(text)) AS indent, (ltrim(text) LIKE 'def %' OR ltrim(text) LIKE 'class %') AS is_header,
      (trim(text) <> '' AND NOT ltrim(text) LIKE '#%') AS is_code FROM o_py_lines"""
LED = """
    SELECT m.path, m.line_no, max(h.line_no) AS func_start FROM o_marks m JOIN o_marks h ON h.path = m.path AND h.is_header AND h.line_no <= m.line_no
    JOIN (SELECT DISTINCT file_path, line_start FROM v_code_findings) f ON f.file_path = m.path AND f.line_start = m.line_no GROUP BY m.path, m.line_no"""
FUNCTIONS = """
    SELECT l.path, l.line_no, l.func_start, (SELECT min(e.line_no) FROM o_marks e JOIN o_marks h ON h.path = l.path AND h.line_no = l.func_start
        WHERE e.path = l.path AND e.is_code AND e.line_no > l.line_no AND e.line_no > l.func_start + 1 AND e.indent <= h.indent) - 1 AS func_end FROM o_led l"""


@query("enclosing_function", """
    SELECT f.file_path AS path, CAST(f.line_start AS BIGINT) AS line_no, CAST(u.func_start AS BIGINT) AS func_start,
      CAST(CASE WHEN u.func_start IS NULL THEN NULL ELSE coalesce(u.func_end, z.n_lines) END AS BIGINT) AS func_end
    FROM (SELECT DISTINCT file_path, line_start FROM v_code_findings) f LEFT JOIN o_functions u ON u.path = f.file_path AND u.line_no = f.line_start
    LEFT JOIN (SELECT path, max(line_no) AS n_lines FROM o_py_lines GROUP BY path) z ON z.path = f.file_path""",
       {"o_marks": MARKS, "o_led": LED, "o_functions": FUNCTIONS})
def enclosing_function(t):
    targets = t.code_findings.select(F.col("file_path").alias("path"), F.col("line_start").alias("line_no"))
    return context.enclosing_function(targets, t.py_files).select("path", *[F.col(c).cast("long").alias(c) for c in ("line_no", "func_start", "func_end")])


@query("import_block", """
    SELECT path, md5(coalesce(string_agg(text || chr(10), '' ORDER BY line_no) FILTER (is_imp AND (stop IS NULL OR line_no < stop)), '')) AS imports_md5,
      CAST(count(*) FILTER (is_imp AND (stop IS NULL OR line_no < stop)) AS BIGINT) AS import_count
    FROM (SELECT l.*, s.stop FROM o_imports l LEFT JOIN (
        SELECT i.path, min(i.line_no) AS stop FROM o_imports i JOIN (SELECT path, min(line_no) AS first FROM o_imports WHERE is_imp GROUP BY path) f ON f.path = i.path
        WHERE i.is_stop AND i.line_no > f.first GROUP BY i.path) s ON s.path = l.path) GROUP BY path""",
       {"o_imports": """
    SELECT path, line_no, text, (trim(text) LIKE 'import %' OR trim(text) LIKE 'from %') AS is_imp,
      (trim(text) <> '' AND NOT (trim(text) LIKE 'import %' OR trim(text) LIKE 'from %') AND NOT trim(text) LIKE '#%' AND NOT starts_with(trim(text), '\"\"\"') AND NOT starts_with(trim(text), '''''''')) AS is_stop FROM o_py_lines"""})
def import_block(t):
    return context.import_block(t.py_files).select("path", F.md5("imports").alias("imports_md5"), "import_count")


@query("scan_sequence", "SELECT scan_id, target, CAST(row_number() OVER (ORDER BY scan_ts, target, scan_id) AS BIGINT) AS seq FROM v_scans")
def scan_sequence(t):
    return trends.scan_sequence(t.scans.select("scan_id", "target", "scan_ts")).select("scan_id", "target", "seq")


@query("first_last_scan", """
    SELECT target, CAST(max(scan_id) FILTER (f = 1) AS BIGINT) AS first_scan, CAST(max(scan_id) FILTER (l = 1) AS BIGINT) AS last_scan,
      CAST(max(total_findings) FILTER (f = 1) AS BIGINT) AS first_total, CAST(max(total_findings) FILTER (l = 1) AS BIGINT) AS last_total
    FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY scan_ts, scan_id) AS f, row_number() OVER (PARTITION BY target ORDER BY scan_ts DESC, scan_id DESC) AS l FROM v_scans) GROUP BY target""")
def first_last_scan(t):
    return trends.first_last(t.scans)


@query("recent_history", """
    SELECT target, scan_id, CAST(total_findings AS BIGINT) AS total_findings, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY target ORDER BY scan_ts DESC, scan_id DESC) AS rank FROM v_scans) WHERE rank <= 5""")
def recent_history(t):
    return trends.recent_history(t.scans).select("target", "scan_id", "total_findings", F.col("rank").cast("long").alias("rank"))


@query("fallback_select", """
    SELECT finding_id, CAST(min(chain_pos) FILTER (ok) AS BIGINT) AS chosen_pos, arg_min(latency_ms, chain_pos) FILTER (ok) AS chosen_latency_ms,
      CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (ok) AS BIGINT) AS ok_calls FROM v_provider_calls GROUP BY finding_id""")
def fallback_select(t):
    return repair.fallback_select(t.provider_calls).withColumn("chosen_pos", F.col("chosen_pos").cast("long"))


@query("timeline", "SELECT strftime(scan_ts, '%Y-%m-%d') AS timestamp, CAST(total_findings AS BIGINT) AS total, CAST(critical_count AS BIGINT) AS critical, CAST(high_count AS BIGINT) AS high FROM v_scans ORDER BY scan_ts, scan_id")
def timeline(t):
    return trends.timeline(t.scans).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd"))


@query("trend_series", "SELECT strftime(scan_ts, '%Y-%m-%d') AS date, CAST(total_findings AS BIGINT) AS total, CAST(critical_count AS BIGINT) AS critical FROM v_scans WHERE scan_ts >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY ORDER BY scan_ts, scan_id")
def trend_series(t):
    return trends.trend_series(t.scans, "2001-08-01", 90)
