"""Counts, trends, rollups and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import enrich, feedback, filters, repair, stats, trends
from scanloom.operators.fusion import ORDER
from scanloom.plans.queries.joining import PRICES
from scanloom.plans.registry import query
from scanloom.schemas import SEVERITIES

# The given scans end in summer 2001; a fixed reference day makes results repeatable.
AS_OF, DAYS = "2001-08-01", 365
SINCE = f"scan_ts >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"


def six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("severity_distribution", f"""
    SELECT s.severity, CAST(count(f.severity) AS BIGINT) AS n FROM (SELECT unnest({SEVERITIES}) AS severity) s LEFT JOIN v_findings f ON f.severity = s.severity GROUP BY s.severity""")
def severity_distribution(t):
    return stats.severity_distribution(t.findings)


@query("scanner_distribution", "SELECT scanner, CAST(count(*) AS BIGINT) AS n FROM v_feedback GROUP BY scanner")
def scanner_distribution(t):
    return stats.count_by(t.feedback, "scanner")


@query("cwe_counts_top10", "SELECT cwe_id, CAST(count(*) AS BIGINT) AS n FROM v_findings WHERE cwe_id <> '' GROUP BY cwe_id ORDER BY n DESC, cwe_id LIMIT 10")
def cwe_counts_top10(t):
    return stats.cwe_counts(t.findings)


@query("patch_success", """
    SELECT target, CAST(count(*) AS BIGINT) AS total_findings, CAST(count(*) FILTER (patch_validated) AS BIGINT) AS validated_patches,
      round(count(*) FILTER (patch_validated)::DOUBLE / greatest(count(*), 1), 6) AS patch_success_rate FROM v_findings GROUP BY target""")
def patch_success(t):
    return six(stats.patch_success(t.findings, ("target",)), "patch_success_rate")


@query("raw_scanner_counts", """
    SELECT scan_id, string_agg(scanner || '=' || CAST(n AS STRING), ',' ORDER BY scanner) AS raw_scanner_results
    FROM (SELECT scan_id, scanner, count(*) AS n FROM v_findings GROUP BY scan_id, scanner) GROUP BY scan_id""")
def raw_scanner_counts(t):
    return stats.raw_scanner_counts(t.findings)


@query("scanner_results_json", """
    SELECT scan_id, '{' || string_agg('"' || scanner || '":' || CAST(n AS STRING), ',' ORDER BY scanner) || '}' AS scanner_results
    FROM (SELECT scan_id, scanner, count(*) AS n FROM v_findings GROUP BY scan_id, scanner) GROUP BY scan_id""")
def scanner_results_json(t):
    return stats.scanner_results_json(t.findings)


SEV_SUMS = ", ".join(f"CAST(count(*) FILTER (severity = '{s}') AS BIGINT) AS {s.lower()}_count" for s in SEVERITIES)


def statistics_sql(by: str, source: str) -> str:
    return f"""
    SELECT w.*, s.scanner_distribution, c.top_cwes FROM (
      SELECT {by}, CAST(count(*) AS BIGINT) AS total_findings, {SEV_SUMS}, CAST(count(*) FILTER (patch_validated) AS BIGINT) AS validated_patches,
        round(count(*) FILTER (patch_validated)::DOUBLE / count(*), 6) AS patch_success_rate FROM {source} GROUP BY {by}) w
    LEFT JOIN (SELECT {by}, string_agg(scanner || '=' || CAST(n AS STRING), ',' ORDER BY scanner) AS scanner_distribution
      FROM (SELECT {by}, scanner, count(*) AS n FROM {source} GROUP BY {by}, scanner) GROUP BY {by}) s ON s.{by} = w.{by}
    LEFT JOIN (SELECT {by}, coalesce(string_agg(cwe_id || '=' || CAST(n AS STRING), ',' ORDER BY n DESC, cwe_id), '') AS top_cwes
      FROM (SELECT {by}, cwe_id, count(*) AS n, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, cwe_id) AS rk FROM {source} WHERE cwe_id <> '' GROUP BY {by}, cwe_id)
      WHERE rk <= 10 GROUP BY {by}) c ON c.{by} = w.{by}"""


def _statistics(df, by):
    out = six(stats.scan_statistics(df, by=(by,)), "patch_success_rate")
    return out.withColumn("top_cwes", F.nullif("top_cwes", F.lit("")))


@query("scan_statistics", statistics_sql("scan_id", "v_findings"))
def scan_statistics(t):
    return _statistics(t.findings, "scan_id")


@query("target_statistics", statistics_sql("target", "v_findings"))
def target_statistics(t):
    """The same statistics per target: few, large groups."""
    return _statistics(t.findings, "target")


@query("critical_high", "SELECT scan_id, CAST(count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS BIGINT) AS critical_high FROM v_findings GROUP BY scan_id")
def critical_high(t):
    return stats.serious_count(t.findings)


@query("gate", """
    SELECT scan_id, CAST(count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS BIGINT) AS critical_high, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) > 0 AS fails
    FROM v_findings GROUP BY scan_id""")
def gate(t):
    return stats.gate(t.findings)


@query("trend_summary", f"""
    SELECT CAST({DAYS} AS BIGINT) AS period_days, CAST(count(*) AS BIGINT) AS scans,
      CASE WHEN count(*) = 0 THEN 'no_data' WHEN max(total_findings) FILTER (last_no = 1) < 0.8 * max(total_findings) FILTER (first_no = 1) THEN 'improving'
        WHEN max(total_findings) FILTER (last_no = 1) > 1.2 * max(total_findings) FILTER (first_no = 1) THEN 'worsening' ELSE 'stable' END AS trend_direction,
      round(avg(total_findings), 6) AS avg_findings_per_scan, CAST(sum(critical_count) AS BIGINT) AS total_critical, CAST(sum(high_count) AS BIGINT) AS total_high,
      round(sum(validated_patches)::DOUBLE / greatest(sum(total_findings), 1), 6) AS patch_success_rate
    FROM (SELECT *, row_number() OVER (ORDER BY scan_ts, scan_id) AS first_no, row_number() OVER (ORDER BY scan_ts DESC, scan_id DESC) AS last_no FROM v_scans WHERE {SINCE})""")
def trend_summary(t):
    return (six(trends.trend_summary(t.scans, AS_OF, DAYS), "avg_findings_per_scan", "patch_success_rate")
            .withColumn("period_days", F.col("period_days").cast("long")))


@query("trend_window_filter", f"SELECT scan_id, target, CAST(total_findings AS BIGINT) AS total_findings FROM v_scans WHERE {SINCE}")
def trend_window_filter(t):
    return trends.in_window(t.scans, AS_OF, DAYS).select("scan_id", "target", "total_findings")


HISTORY = """SELECT scan_id, severity, cwe_id, CASE WHEN ai_patch <> '' THEN 1 ELSE 0 END AS g, CASE WHEN patch_validated THEN 1 ELSE 0 END AS v FROM v_findings"""
TOP_CWE = """
    SELECT cwe_id, CAST(count(*) AS BIGINT) AS count, CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END)
      WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity
    FROM v_findings WHERE cwe_id <> '' GROUP BY cwe_id"""


def _history(t):
    from scanloom.sinks.history import finding_rows
    return finding_rows(t.findings)


@query("top_cwe", TOP_CWE + " ORDER BY count DESC, cwe_id LIMIT 10")
def top_cwe(t):
    return trends.top_cwe(_history(t))


@query("topk_cwe", TOP_CWE + " ORDER BY count DESC, cwe_id LIMIT 3")
def topk_cwe(t):
    return trends.top_cwe(_history(t), 3)


@query("nonempty_cwe", "SELECT severity, CAST(count(*) AS BIGINT) AS n FROM v_findings WHERE cwe_id <> '' GROUP BY severity")
def nonempty_cwe(t):
    return stats.count_by(t.findings.filter("cwe_id <> ''"), "severity")


@query("topk_per_target", """
    SELECT target, cwe_id, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank FROM (
      SELECT target, cwe_id, count(*) AS n, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, cwe_id) AS rank FROM v_findings WHERE cwe_id <> '' GROUP BY target, cwe_id) WHERE rank <= 10""")
def topk_per_target(t):
    return stats.top_per_group(t.findings).withColumn("rank", F.col("rank").cast("long"))


@query("fix_rate_by_severity", """
    SELECT severity, round(sum(g)::DOUBLE / greatest(count(*), 1), 6) AS patch_rate, round(sum(v)::DOUBLE / greatest(sum(g), 1), 6) AS validation_rate, CAST(count(*) AS BIGINT) AS total
    FROM o_history GROUP BY severity""", {"o_history": HISTORY})
def fix_rate_by_severity(t):
    return six(trends.fix_rate_by_severity(_history(t)), "patch_rate", "validation_rate")


@query("feedback_stats", """
    SELECT CAST(count(*) AS BIGINT) AS total_samples, CAST(count(*) FILTER (is_true_positive = 1) AS BIGINT) AS true_positives,
      CAST(count(*) FILTER (is_true_positive = 0) AS BIGINT) AS false_positives, CAST(count(*) FILTER (is_true_positive IS NULL) AS BIGINT) AS pending FROM v_feedback""")
def feedback_stats(t):
    return feedback.feedback_stats(t.feedback)


@query("labelled_only", "SELECT finding_id, CAST(is_true_positive AS BIGINT) AS is_true_positive FROM v_feedback WHERE is_true_positive IS NOT NULL")
def labelled_only(t):
    return feedback.labelled_only(t.feedback).select("finding_id", F.col("is_true_positive").cast("long").alias("is_true_positive"))


@query("token_usage", f"""
    SELECT c.model, CAST(count(*) AS BIGINT) AS calls, CAST(sum(tokens_prompt) AS BIGINT) AS tokens_prompt, CAST(sum(tokens_completion) AS BIGINT) AS tokens_completion,
      CAST(sum(tokens_prompt + tokens_completion) AS BIGINT) AS tokens_used,
      round(sum(tokens_prompt / 1e6 * coalesce(p.price_in, 0)::DOUBLE + tokens_completion / 1e6 * coalesce(p.price_out, 0)::DOUBLE), 6) AS cost_usd
    FROM v_llm_calls c LEFT JOIN (SELECT * FROM {PRICES}) p ON p.model = c.model GROUP BY c.model""")
def token_usage(t):
    return six(enrich.token_usage(t.llm_calls), "cost_usd")


@query("repair_rollup", """
    SELECT finding_id, first_ok IS NOT NULL AS success, CAST(coalesce(first_ok, last_attempt) AS BIGINT) AS total_attempts,
      CASE WHEN first_ok IS NOT NULL THEN ok_patch ELSE last_patch END AS final_patch,
      CASE WHEN first_ok IS NOT NULL THEN 'Fixed in ' || CAST(first_ok AS STRING) || ' attempt(s). Strategy: escape'
        WHEN last_patch <> '' THEN 'Best-effort patch after 3 attempts. Manual review required.' ELSE '' END AS agent_reasoning
    FROM (SELECT finding_id, min(attempt_num) FILTER (validation_passed) AS first_ok, max(attempt_num) AS last_attempt,
        arg_min(patch, attempt_num) FILTER (validation_passed) AS ok_patch, arg_max(patch, attempt_num) AS last_patch FROM v_attempts GROUP BY finding_id)""")
def repair_rollup(t):
    return repair.repair_rollup(t.attempts, strategy=F.lit("escape")).withColumn("total_attempts", F.col("total_attempts").cast("long"))


@query("distinct_scanners", "SELECT DISTINCT scanner FROM v_feedback")
def distinct_scanners(t):
    return filters.distinct_scanners(t.feedback)


# A prediction that needs no model: long texts count as false positives.
PREDICTED = "SELECT CASE WHEN is_true_positive = 0 THEN 1 ELSE 0 END AS label, CASE WHEN length(code_snippet) > 1500 THEN 1 ELSE 0 END AS prediction FROM v_feedback WHERE is_true_positive IS NOT NULL"


@query("report_eval", """
    SELECT CAST(sum(support) AS BIGINT) AS samples, round(sum(hit)::DOUBLE / sum(support), 6) AS accuracy,
      round(sum(support * CASE WHEN guessed > 0 THEN hit::DOUBLE / guessed ELSE 0 END) / sum(support), 6)::DOUBLE AS precision,
      round(sum(support * CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END) / sum(support), 6)::DOUBLE AS recall
    FROM (SELECT c.cls, count(*) FILTER (label = c.cls) AS support, count(*) FILTER (prediction = c.cls) AS guessed, count(*) FILTER (label = c.cls AND prediction = c.cls) AS hit
      FROM o_predicted, (SELECT unnest([0, 1]) AS cls) c GROUP BY c.cls)""", {"o_predicted": PREDICTED})
def report_eval(t):
    rows = feedback.labelled_only(t.feedback).select(
        F.when(F.col("is_true_positive") == 0, 1.0).otherwise(0.0).alias("label"),
        F.when(F.length("code_snippet") > 1500, 1.0).otherwise(0.0).alias("prediction"))
    return six(feedback.evaluate(rows), "accuracy", "precision", "recall")


@query("first_findings", f"SELECT scan_id, file_path, CAST(line_start AS BIGINT) AS line_start, rule_id FROM v_findings ORDER BY {', '.join('v_findings.' + c for c in ORDER)} LIMIT 5")
def first_findings(t):
    return stats.first_findings(t.findings, list(ORDER)).select("scan_id", "file_path", F.col("line_start").cast("long").alias("line_start"), "rule_id")


@query("view_filters", "SELECT finding_id, severity, scanner FROM v_feedback WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AND scanner IN ('bandit', 'semgrep') AND coalesce(is_true_positive, 1) = 1")
def view_filters(t):
    shown = t.feedback.withColumn("is_false_positive", F.coalesce("is_true_positive", F.lit(1)) == 0)
    return filters.view(shown, scanners=["bandit", "semgrep"]).select("finding_id", "severity", "scanner")
