"""Plug-ins, the filter model, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.falsepos import FEATURES
from scanloom.functions.patches import native_verdict
from scanloom.operators import feedback, plugins
from scanloom.operators.enrich import pair_by_finding
from scanloom.operators.scan import scan_rules
from scanloom.plans.queries.rules import NOT_ALLOWED, _with_entropy
from scanloom.plans.registry import query
from scanloom.rules.catalogue import Rule
from scanloom.session import materialise, run_dir
from scanloom.sinks import reports
from scanloom.streaming import streams


def todo_scanner(files):
    """A user scanner: files whose text has a line with a question mark."""
    return files.filter(F.col("content").contains("?")).select(
        F.lit("user.question").alias("rule_id"), F.lit("question").alias("check_name"), F.lit("low").alias("severity"), "path", F.lit(1).alias("line"))


@query("scanner_plugin", """
    SELECT 'question' AS scanner, 'question' AS rule_name, 'LOW' AS severity, path AS file_path, CAST(1 AS BIGINT) AS line_start FROM v_docs WHERE contains(content, '?')""")
def scanner_plugin(t):
    registry = plugins.ScannerRegistry({})
    registry.register("question", todo_scanner)
    registry.register("broken", lambda files: files.select("no_such_column"))
    out = registry.run(t.docs)
    return out.select("scanner", "rule_name", "severity", "file_path", F.col("line_start").cast("long").alias("line_start"))


USER_RULES = [Rule("tf.any_true", r"=\s*true\b", None, "Something is switched on.", "LOW", "CWE-1188")]


@query("rule_plugin", r"""
    SELECT path AS file_path, CAST(line_no AS BIGINT) AS line_start, 'any_true' AS rule_name, 'LOW' AS severity, 'CWE-1188' AS cwe_id, text AS code_snippet
    FROM o_config_lines WHERE family = 'tf' AND regexp_matches(text, '(?i)=\s*true\b')""")
def rule_plugin(t):
    return scan_rules(t.config_files, USER_RULES).select("file_path", F.col("line_start").cast("long").alias("line_start"), "rule_name", "severity", "cwe_id", "code_snippet")


@query("report_plugin", "SELECT scan_id, CAST(count(*) AS STRING) || ' findings' AS text FROM v_findings GROUP BY scan_id")
def report_plugin(t):
    reports.register_reporter("count", lambda findings, scans: findings.groupBy("scan_id").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" findings")).alias("text")))
    return reports.report(t.findings, t.scan_heads, "count")


@query("validator_plugin", """
    SELECT file_path, CASE WHEN file_path LIKE '%.js' THEN ai_patch LIKE '%widget%' ELSE TRUE END AS is_valid,
      CASE WHEN file_path LIKE '%.js' THEN 'checked js' WHEN file_path LIKE '%.java' THEN 'No validator for .java, assuming valid' ELSE 'No validator for .tf, assuming valid' END AS check_message, CAST(count(*) AS BIGINT) AS n
    FROM v_findings WHERE ai_patch <> '' AND NOT file_path LIKE '%.py' GROUP BY 1, 2, 3""")
def validator_plugin(t):
    js = F.struct(F.col("ai_patch").contains("widget").alias("is_valid"), F.lit("checked js").alias("message"))
    v = native_verdict(F.col("file_path"), F.col("ai_patch"), {"js": js})
    return (t.findings.filter("ai_patch <> ''").withColumn("v", v).filter("v IS NOT NULL")
            .groupBy("file_path", "v.is_valid", F.col("v.message").alias("check_message")).agg(F.count(F.lit(1)).alias("n")))


def echo_client(texts: list[str]) -> list[str]:
    """Stands for a model client: answers with the length of what it was asked."""
    return [f"seen {len(x)} characters" for x in texts]


@query("completion_stage", """
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, 'seen ' || CAST(length(prompt) AS STRING) || ' characters' AS answer FROM v_llm_calls""")
def completion_stage(t):
    asked = t.llm_calls.withColumn("id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    answers = plugins.completion_stage(asked, echo_client)
    return (pair_by_finding(asked, answers, key="id", answer="response", into="answer")
            .select("conv_id", F.col("turn").cast("long").alias("turn"), "answer"))


# ---------------------------------------------------------------- model

def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


@query("fp_train", """
    SELECT CASE WHEN count(*) < 50 THEN 'insufficient_data' ELSE 'trained' END AS status, CAST(count(*) AS BIGINT) AS samples, TRUE AS in_range
    FROM v_feedback WHERE is_true_positive IS NOT NULL""")
def fp_train(t):
    """Training report; forests differ between libraries, so scores are compared by their range only."""
    report = feedback.train_fp(t.feedback)[1]
    shares = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall") if c in report.columns]
    return report.select("status", F.col("samples").cast("long").alias("samples"), _all(shares).alias("in_range"))


@query("fp_predict", "SELECT severity, CAST(count(*) AS BIGINT) AS n, TRUE AS in_range FROM v_findings GROUP BY severity")
def fp_predict(t):
    """Scores of all findings by a model trained on the labels."""
    model, _ = feedback.train_fp(t.feedback)
    findings = t.findings.withColumns({"context_before": F.lit(""), "context_after": F.lit("")})
    scored = feedback.score_fp(findings, model)
    flagged = F.col("is_false_positive") == (F.col("fp_confidence") > feedback.FP_THRESHOLD)
    return scored.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("fp_confidence").between(0, 1) & flagged).alias("in_range"))


@query("fp_training_set", """
    SELECT finding_id, CASE WHEN is_true_positive = 0 THEN 1 ELSE 0 END::DOUBLE AS label, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END::DOUBLE AS f_severity,
      0.7::DOUBLE AS f_confidence, length(code_snippet)::DOUBLE AS f_snippet_len, length(message)::DOUBLE AS f_message_len, 0::DOUBLE AS f_has_before, 0::DOUBLE AS f_has_after,
      CASE split_part(scanner, '(', 1) WHEN 'bandit' THEN 1 WHEN 'fusion' THEN 3 ELSE 0 END::DOUBLE AS f_scanner, 0::DOUBLE AS f_cwe, 1::DOUBLE AS f_span FROM v_feedback WHERE is_true_positive IS NOT NULL""")
def fp_training_set(t):
    """What the model learns from: labelled rows, nine features, label."""
    return feedback.training_rows(t.feedback).select("finding_id", "label", *FEATURES)


@query("fp_model_store", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS differing FROM v_feedback WHERE is_true_positive IS NOT NULL")
def fp_model_store(t):
    """A saved and reloaded model scores like the one that was saved."""
    model, _ = feedback.train_fp(t.feedback)
    path = run_dir(t.spark, "model")
    rows = feedback.training_rows(t.feedback)
    if model is None:
        return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("differing"))
    feedback.save_model(model, path)
    again = feedback.load_model(path)
    # Score once with each model in one row-wise pass, so no join on ids is needed.
    first = feedback.score_fp(rows, model).withColumnRenamed("fp_confidence", "a").drop("is_false_positive", *FEATURES)
    both = feedback.score_fp(first, again)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("fp_confidence")).alias("differing"))


# ---------------------------------------------------------------- streams

@query("stream_scan_plugin", "SELECT 'question' AS scanner, path AS file_path FROM v_docs WHERE contains(content, '?')")
def stream_scan_plugin(t):
    """A user's scanner on a stream."""
    files = (streams.read_parquet_stream(t.spark, t.folder, "documents.parquet")
             .select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content")))
    out = run_dir(t.spark, "scan")
    streams.stream_scan(files, out + "/rows", out + "/state", registry=plugins.ScannerRegistry({"question": todo_scanner}))
    return streams.current_findings(t.spark, out + "/rows").select("scanner", "file_path")


@query("stream_scan", f"""
    SELECT 'config_audit' AS scanner, rule_id, path AS file_path, CAST(line_no AS BIGINT) AS line_start FROM o_rule_hits
    UNION ALL SELECT 'secret_scanner', 'secret.' || kind, path, CAST(line_no AS BIGINT) FROM o_secrets WHERE (kind <> 'high_entropy' OR entropy > 4.5) AND {NOT_ALLOWED}""",
       {"o_secrets": _with_entropy("o_secret_lines")})
def stream_scan(t):
    """Both built-in scanners over files that arrive twice: some in an older version first, then all as they are."""
    out = run_dir(t.spark, "scan")
    files = t.config_files.unionByName(t.secret_files)
    older = F.when(F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(7)) == 0, F.concat("content", F.lit("\nUSER root\nprivileged: true\n"))).otherwise(F.col("content"))
    for version in (files.withColumn("content", older), files):
        version.write.mode("append").parquet(out + "/in")
        streams.stream_scan(streams.read_parquet_stream(t.spark, out + "/in", "*.parquet"), out + "/rows", out + "/state")
    return streams.current_findings(t.spark, out + "/rows").select("scanner", "rule_id", "file_path", F.col("line_start").cast("long").alias("line_start"))


def _event_stream(t):
    sev = (F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "HIGH").when(F.col("event_type") == "signup", "MEDIUM")
           .when(F.col("event_type") == "click", "LOW").otherwise("INFO"))
    return (streams.read_parquet_stream(t.spark, t.folder, "events.parquet")
            .select(F.col("ts").cast("timestamp").alias("ts"), sev.alias("severity"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("id")))


# Reports come in four deliveries by time; every eleventh comes one delivery late, some of these too late for the watermark.
DELIVERIES = """
    SELECT event_id, id, severity, ts, least(3, CAST(floor(4.0 * (epoch_ms(ts) - a) / (z - a + 1)) AS INTEGER)) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS delivery
    FROM v_reports_in, (SELECT epoch_ms(min(ts)) AS a, epoch_ms(max(ts)) AS z FROM v_reports_in)"""


@query("stream_dedup", """
    SELECT k.event_id, id, k.at AS ts_us FROM (
      SELECT id, unnest(list_reduce(list({'at': epoch_us(ts), 'event_id': event_id} ORDER BY delivery, ts, event_id),
        lambda acc, x: CASE WHEN len(list_filter(acc, lambda l: abs(l.at - x.at) <= 604800000000)) > 0 THEN acc ELSE list_append(acc, x) END,
        list({'at': epoch_us(ts), 'event_id': event_id})[:0])) AS k FROM o_on_time GROUP BY id)""",
       {"o_deliveries": DELIVERIES,
        "o_latest": "SELECT delivery, max(max(ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM o_deliveries GROUP BY delivery",
        "o_on_time": "SELECT d.* FROM o_deliveries d JOIN o_latest l ON l.delivery = d.delivery WHERE latest IS NULL OR epoch_ms(ts) > epoch_ms(latest) - 604800000"})
def stream_dedup(t):
    """Several deliveries, rows out of order and too late, and a restart after each."""
    out = run_dir(t.spark, "dedup")
    reports = t.reports_in.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "id", "severity", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    ends = reports.agg(F.min("ms").alias("a"), F.max("ms").alias("z")).first()
    part = F.least(F.lit(3), F.floor(4.0 * (F.col("ms") - (ends.a or 0)) / ((ends.z or 0) - (ends.a or 0) + 1)).cast("int")) + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    dealt = materialise(reports.withColumn("delivery", part), "deliveries")
    for n in range(5):
        dealt.filter(F.col("delivery") == n).drop("delivery", "ms").write.mode("append").parquet(out + "/in")
        streams.stream_dedup(streams.read_parquet_stream(t.spark, out + "/in", "*.parquet"), out + "/rows", out + "/state", delay="7 days")
    return t.spark.read.parquet(out + "/rows").select("event_id", "id", F.unix_micros("ts").alias("ts_us"))


@query("stream_trend", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, severity, CAST(count(*) AS BIGINT) AS n FROM v_reports_in GROUP BY 1, 2""")
def stream_trend(t):
    out = run_dir(t.spark, "trend")
    streams.stream_trend(_event_stream(t), out + "/rows", out + "/state")
    return streams.latest_counts(t.spark, out + "/rows").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "severity", "n")


@query("stream_trend_sliding", """
    SELECT strftime(w, '%Y-%m-%d') AS day, severity, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT severity, unnest([date_trunc('day', ts) - INTERVAL (i) DAY FOR i IN range(0, 30)]) AS w FROM v_reports_in) GROUP BY 1, 2""")
def stream_trend_sliding(t):
    """Batch form of the trailing 30-day counts."""
    return (streams.windowed_counts(t.reports_in.withColumn("ts", F.col("ts").cast("timestamp")), size="30 days", slide="1 day")
            .select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "severity", "n"))
