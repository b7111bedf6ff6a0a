"""Sources: files, manifests, scanner reports, dimensions, history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanloom.operators import incremental as inc
from scanloom.plans.registry import query
from scanloom.rules.catalogue import RULES
from scanloom.rules.knowledge import ENTRIES, knowledge_base
from scanloom.session import run_dir
from scanloom.sinks import history
from scanloom.sources import files as src
from scanloom.sources import scanners as ing

SMALL_FILE = 4_000


def literal_rows(rows, names):
    """VALUES text for an oracle."""
    def lit(x):
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS fixed({', '.join(names)})"


RULE_VALUES = literal_rows([(r.id, r.message, r.severity, r.cwe) for r in RULES], ["rule_id", "message", "severity", "cwe_id"])


@query("source_files", """
    SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS n_bytes, CAST(length(content) AS BIGINT) AS n_chars,
      sha256(content) AS hash FROM v_docs""")
def source_files(t):
    return t.docs.select("path", F.octet_length("content").cast("long").alias("n_bytes"),
                         F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("hash"))


@query("source_lines", "SELECT path, CAST(line_no AS BIGINT) AS line_no, md5(text) AS text_md5 FROM o_doc_lines")
def source_lines(t):
    return src.source_lines(t.docs).select("path", F.col("line_no").cast("long").alias("line_no"), F.md5("text").alias("text_md5"))


@query("source_lines_ranges", """
    SELECT CAST(row_number() OVER (ORDER BY doc_id, line_no) AS BIGINT) AS line_no, md5(text) AS text_md5 FROM (
      SELECT doc_id, generate_subscripts(s, 1) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))""")
def source_lines_ranges(t):
    """The documents as text files that are read back in ranges of 64 KB; lines are numbered through all files in their order."""
    folder = run_dir(t.spark, "texts")
    t.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("text").write.text(folder)
    lines = src.read_source_lines(t.spark, folder, universal=False, split_bytes=64 * 1024)
    files = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(files.select("path", before.alias("before")), "path").select((F.col("before") + F.col("line_no")).alias("line_no"), F.md5("text").alias("text_md5"))


@query("size_cap", f"SELECT path FROM v_docs WHERE octet_length(encode(content)) <= {SMALL_FILE}")
def size_cap(t):
    return src.size_cap(t.docs, SMALL_FILE).select("path")


CHANGES = """
    SELECT coalesce(h.path, b.path) AS path,
      CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'deleted' WHEN sha256(b.content) <> sha256(h.content) THEN 'modified' ELSE 'same' END AS change
    FROM v_base b FULL OUTER JOIN v_head h ON b.path = h.path"""


def _manifests(t):
    return inc.manifest(t.base), inc.manifest(t.head)


@query("changed_files", """
    SELECT path FROM o_changes WHERE change IN ('added', 'modified')
    UNION SELECT s.path FROM v_staged s JOIN v_head h ON s.path = h.path""", {"o_changes": CHANGES})
def changed_files(t):
    return inc.changed_files(*_manifests(t), t.staged)


@query("changed_stats", """
    SELECT 'main' AS base_ref, CAST(count(*) FILTER (change IN ('added', 'modified')) AS BIGINT) AS files_changed,
      CAST(count(*) FILTER (change = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (change = 'modified') AS BIGINT) AS modified,
      CAST(count(*) FILTER (change = 'deleted') AS BIGINT) AS deleted FROM o_changes""", {"o_changes": CHANGES})
def changed_stats(t):
    return inc.changed_stats(*_manifests(t))


@query("changed_stats_staged", """
    SELECT 'main' AS base_ref, CAST((SELECT count(*) FROM (SELECT path FROM o_changes WHERE change IN ('added', 'modified') UNION SELECT s.path FROM v_staged s JOIN v_head h ON s.path = h.path)) AS BIGINT) AS files_changed,
      CAST(count(*) FILTER (change = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (change = 'modified') AS BIGINT) AS modified,
      CAST(count(*) FILTER (change = 'deleted') AS BIGINT) AS deleted FROM o_changes""", {"o_changes": CHANGES})
def changed_stats_staged(t):
    """With staged files, as the list of changed files has them."""
    return inc.changed_stats(*_manifests(t), staged=t.staged)


# ---- reports of other scanners, as JSON text built from the findings

def semgrep_reports(t):
    """One report per finding: its result, and a second result that has nothing but its check id."""
    level = (F.when(F.col("severity") == "CRITICAL", "error").when(F.col("severity") == "HIGH", "WARNING")
             .when(F.col("severity") == "MEDIUM", "info").when(F.col("severity") == "LOW", "odd"))
    word = F.when(F.col("confidence") == 0.9, "high").when(F.col("confidence") == 0.7, "MEDIUM").when(F.col("confidence") == 0.5, "low")
    scalar = F.to_json(F.struct(word.alias("confidence"), F.col("cwe_id").alias("cwe"), F.lit("A03").alias("owasp")))
    listed = F.to_json(F.struct(word.alias("confidence"), F.array("cwe_id", F.lit("CWE-0")).alias("cwe"), F.array().cast("array<string>").alias("owasp")))
    meta = F.when(F.col("line_start") % 3 == 0, scalar).when(F.col("line_start") % 3 == 1, listed).otherwise("{}")
    body = F.to_json(F.struct(
        F.concat(F.lit("pack.sub."), "rule_id").alias("check_id"), F.col("file_path").alias("path"),
        F.struct(F.col("line_start").alias("line"), F.lit(1).alias("col")).alias("start"),
        F.struct(F.col("line_end").alias("line"), F.lit(9).alias("col")).alias("end"),
        F.struct("message", level.alias("severity"), F.col("code_snippet").alias("lines"), F.lit("@").alias("metadata")).alias("extra")))
    first = F.replace(body, F.lit('"metadata":"@"'), F.concat(F.lit('"metadata":'), meta))
    second = F.concat(F.lit('{"check_id":"solo'), F.col("line_start").cast("string"), F.lit('"}'))
    errors = F.when(F.col("severity") == "INFO", '["e1","e2"]').otherwise("[]")
    report = F.concat(F.lit('{"results":['), first, F.lit(","), second, F.lit('],"errors":'), errors,
                      F.when(F.col("severity") == "LOW", ',"time":{"total_time":1.5}').otherwise(""), F.lit("}"))
    return t.findings.select("scan_id", report.alias("report"))


SEMGREP_ROWS = """
    SELECT scan_id, 'pack.sub.' || rule_id AS rule_id, split_part(rule_id, '.', 2) AS rule_name, message,
      CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'LOW' WHEN 'LOW' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
      CASE WHEN line_start % 3 = 2 OR confidence = 0.3 THEN 0.7 ELSE confidence END AS confidence,
      CASE WHEN line_start % 3 = 2 THEN '' ELSE cwe_id END AS cwe_id, CASE WHEN line_start % 3 = 0 THEN 'A03' ELSE '' END AS owasp,
      file_path, line_start, line_end, 1 AS column_start, 9 AS column_end, code_snippet FROM v_findings
    UNION ALL
    SELECT scan_id, 'solo' || CAST(line_start AS STRING), 'solo' || CAST(line_start AS STRING), '', 'LOW', 0.7, '', '', '', 0, 0, 0, 0, '' FROM v_findings"""


@query("semgrep_ingest", """
    SELECT scan_id, rule_id, rule_name, message, severity, round(confidence, 6) AS confidence, file_path, CAST(line_start AS BIGINT) AS line_start,
      CAST(line_end AS BIGINT) AS line_end, CAST(column_start AS BIGINT) AS column_start, CAST(column_end AS BIGINT) AS column_end, code_snippet
    FROM o_semgrep""", {"o_semgrep": SEMGREP_ROWS})
def semgrep_ingest(t):
    rows = ing.ingest_semgrep(semgrep_reports(t), keep=("scan_id",))
    longs = {c: F.col(c).cast("long") for c in ("line_start", "line_end", "column_start", "column_end")}
    return (rows.withColumns(longs).withColumn("confidence", F.round("confidence", 6))
            .select("scan_id", "rule_id", "rule_name", "message", "severity", "confidence", "file_path", *longs, "code_snippet"))


@query("semgrep_polymorphic", """
    SELECT cwe_id, owasp, CAST(count(*) AS BIGINT) AS n FROM o_semgrep GROUP BY cwe_id, owasp""", {"o_semgrep": SEMGREP_ROWS})
def semgrep_polymorphic(t):
    return ing.ingest_semgrep(semgrep_reports(t)).groupBy("cwe_id", "owasp").agg(F.count(F.lit(1)).alias("n"))


@query("unreadable_reports", """
    SELECT scan_id, CAST(sum(CASE WHEN line_start % 3 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS findings, CAST(sum(CASE WHEN line_start % 3 = 0 THEN 1 WHEN severity = 'INFO' THEN 2 ELSE 0 END) AS BIGINT) AS errors,
      CAST(sum(CASE WHEN line_start % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unreadable FROM v_findings GROUP BY scan_id""")
def unreadable_reports(t):
    """A third of the reports broken off in the middle: they count as errors and are named."""
    broken = F.when(F.get_json_object("report", "$.results[0].start.line").cast("int") % 3 == 0, F.expr("substr(report, 1, length(report) - 2)")).otherwise(F.col("report"))
    reports = semgrep_reports(t).withColumn("report", broken)
    return (ing.report_metrics(reports, keep=("scan_id",)).groupBy("scan_id")
            .agg(F.sum("finding_count").alias("findings"), F.sum("error_count").alias("errors"), F.count_if("parse_error").alias("unreadable")))


@query("raw_ingest_metrics", """
    SELECT scan_id, CAST(count(*) * 2 AS BIGINT) AS findings, CAST(sum(CASE WHEN severity = 'INFO' THEN 2 ELSE 0 END) AS BIGINT) AS errors,
      round(sum(CASE WHEN severity = 'LOW' THEN 1.5 ELSE 0 END), 6)::DOUBLE AS total_time FROM v_findings GROUP BY scan_id""")
def raw_ingest_metrics(t):
    return (ing.report_metrics(semgrep_reports(t), keep=("scan_id",)).groupBy("scan_id")
            .agg(F.sum("finding_count").alias("findings"), F.sum("error_count").alias("errors"), F.round(F.sum("total_time"), 6).alias("total_time")))


def bandit_reports(t):
    word = F.when(F.col("confidence") == 0.9, "HIGH").when(F.col("confidence") == 0.7, "MEDIUM").when(F.col("confidence") == 0.5, "LOW").otherwise("high")
    cwe = F.when(F.col("line_start") % 2 == 0, F.to_json(F.struct(F.lit(79).alias("id"), F.lit("u").alias("link")))).otherwise(F.to_json(F.array("cwe_id")))
    body = F.to_json(F.struct(
        F.col("rule_id").alias("test_id"), F.col("rule_name").alias("test_name"), F.col("message").alias("issue_text"),
        F.when(F.col("severity") != "INFO", F.col("severity")).alias("issue_severity"), word.alias("issue_confidence"),
        F.when(F.col("line_start") % 2 == 1, F.col("cwe_id")).alias("cwe"), F.col("file_path").alias("filename"),
        F.col("line_start").alias("line_number"), F.col("code_snippet").alias("code")))
    obj = F.when(F.col("line_start") % 2 == 0, F.concat(F.lit('{"cwe":'), cwe, F.lit(","), F.substr(body, F.lit(2)))).otherwise(body)
    return t.findings.select("scan_id", F.concat(F.lit('{"results":['), obj, F.lit("]}")).alias("report"))


@query("bandit_ingest", """
    SELECT scan_id, rule_id, rule_name, message, CASE WHEN severity = 'INFO' THEN 'MEDIUM' ELSE severity END AS severity,
      round(CASE WHEN confidence = 0.3 THEN 0.7 ELSE confidence END, 6) AS confidence, CASE WHEN line_start % 2 = 0 THEN '79' ELSE cwe_id END AS cwe_id,
      file_path, CAST(line_start AS BIGINT) AS line_start, CAST(line_start AS BIGINT) AS line_end, code_snippet FROM v_findings""")
def bandit_ingest(t):
    longs = {c: F.col(c).cast("long") for c in ("line_start", "line_end")}
    return (ing.ingest_bandit(bandit_reports(t), keep=("scan_id",)).withColumns(longs).withColumn("confidence", F.round("confidence", 6))
            .select("scan_id", "rule_id", "rule_name", "message", "severity", "confidence", "cwe_id", "file_path", *longs, "code_snippet"))


@query("bandit_floor", """
    SELECT scan_id, rule_id, CASE WHEN severity = 'INFO' THEN 'MEDIUM' ELSE severity END AS severity FROM v_findings
    WHERE severity IN ('HIGH', 'MEDIUM', 'INFO') AND confidence IN (0.9, 0.7) AND rule_id <> 'rule.3'""")
def bandit_floor(t):
    return (ing.bandit_floor(ing.ingest_bandit(bandit_reports(t), keep=("scan_id",)), skip=["rule.3"])
            .select("scan_id", "rule_id", "severity"))


def raw_rows(t):
    """Rows as scanners hand them over: some use the first name of a field, some an alias, some leave it out."""
    odd = F.col("line_start") % 2 == 1
    pick = lambda c, cond: F.when(cond, F.col(c))
    return t.findings.select(
        "scan_id", F.lower("severity").alias("low"), "confidence", "rule_id",
        pick("cwe_id", odd).alias("cwe_id"), pick("cwe_id", ~odd).alias("cwe"),
        pick("rule_name", odd).alias("rule_name"), pick("rule_name", ~odd).alias("check_name"),
        pick("message", odd).alias("message"), pick("message", ~odd).alias("issue_text"),
        pick("file_path", odd).alias("file_path"), pick("file_path", ~odd).alias("path"),
        pick("line_start", odd).alias("line_start"), F.when(~odd, F.col("line_start")).alias("line"),
        pick("line_end", odd).alias("line_end"),
        pick("code_snippet", odd).alias("code_snippet"), pick("code_snippet", ~odd).alias("code"),
    ).withColumn("severity", F.when(F.col("low") != "info", F.col("low"))).withColumn(
        "confidence", F.when(F.col("confidence") != 0.3, F.col("confidence"))).drop("low")


@query("unify_schema", """
    SELECT scan_id, substr(sha256(file_path || ':' || CAST(line_start AS STRING) || ':' || rule_id || ':' || code_snippet), 1, 16) AS id, 'bandit' AS scanner,
      CASE WHEN severity = 'INFO' THEN 'MEDIUM' ELSE severity END AS severity, round(CASE WHEN confidence = 0.3 THEN 0.7 ELSE confidence END, 6) AS confidence,
      cwe_id, rule_id, rule_name, message, file_path, CAST(line_start AS BIGINT) AS line_start,
      CAST(CASE WHEN line_start % 2 = 1 THEN line_end ELSE line_start END AS BIGINT) AS line_end, code_snippet FROM v_findings""")
def unify_schema(t):
    longs = {c: F.col(c).cast("long") for c in ("line_start", "line_end")}
    return (ing.unify(raw_rows(t), "bandit", keep=("scan_id",)).withColumns(longs).withColumn("confidence", F.round("confidence", 6))
            .select("scan_id", "id", "scanner", "severity", "confidence", "cwe_id", "rule_id", "rule_name", "message", "file_path", *longs, "code_snippet"))


# ---- dimensions, always together with the data they describe

@query("kb_source", f"""
    SELECT f.kb_id, f.name, f.owasp, f.severity_guidance, CAST(count(v.cwe_id) AS BIGINT) AS findings
    FROM {literal_rows([e[:4] for e in ENTRIES], ['kb_id', 'name', 'owasp', 'severity_guidance']).replace('AS fixed', 'AS f')} LEFT JOIN v_findings v ON v.cwe_id = f.kb_id
    GROUP BY f.kb_id, f.name, f.owasp, f.severity_guidance""")
def kb_source(t):
    counted = t.findings.groupBy("cwe_id").agg(F.count(F.lit(1)).alias("n"))
    return (knowledge_base(t.spark).join(counted, F.col("kb_id") == F.col("cwe_id"), "left")
            .select("kb_id", "name", "owasp", "severity_guidance", F.coalesce("n", F.lit(0)).alias("findings")))


@query("history_source", """
    SELECT 'scans' AS tab, CAST(count(*) AS BIGINT) AS n FROM v_scan_heads WHERE scan_timestamp >= TIMESTAMP '2000-01-15'
    UNION ALL SELECT 'findings', CAST(count(*) AS BIGINT) FROM v_findings JOIN v_scan_heads USING (scan_id) WHERE scan_timestamp >= TIMESTAMP '2000-01-15'
    UNION ALL SELECT 'feedback', CAST(count(*) AS BIGINT) FROM v_feedback""")
def history_source(t):
    """Writes the three history tables once, then reads them back with a date filter that prunes partitions."""
    root = run_dir(t.spark, "history")
    history.record_scan(t.findings, t.scan_heads, root, run="first")
    history.record_scan(t.findings, t.scan_heads, root, run="first")  # a replay adds nothing
    labels = t.feedback.withColumn("rule_name", F.lit(""))
    history.record_feedback(labels, F.col("is_true_positive"), root, key="finding_id")
    read = lambda name, since=None: history.read_history(t.spark, root, name, since)
    count = lambda df, name: df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"))
    return (count(read("scans", "2000-01-15"), "scans")
            .unionByName(count(read("findings", "2000-01-15"), "findings"))
            .unionByName(count(read("feedback"), "feedback")))
