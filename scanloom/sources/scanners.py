"""Other scanners' JSON reports to unified finding rows.

A report is one JSON text per row.  It is parsed once, into a variant, from which the fields of a fixed schema are taken; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scalar import confidence_map, finding_id, last_part, severity_map
from scanloom.schemas import FINDING_COLUMNS, conform

_POS = "struct<line: int, col: int>"
_SEMGREP_RESULTS = (
    "array<struct<check_id: string, path: string, start: " + _POS + ", end: " + _POS + ", "
    "extra: struct<message: string, severity: string, lines: string, fingerprint: string, is_ignored: boolean, "
    "validation_state: string, metadata: variant>>>")
_BANDIT_RESULTS = (
    "array<struct<test_id: string, test_name: string, issue_text: string, issue_severity: string, "
    "issue_confidence: string, cwe: string, filename: string, line_number: int, code: string, more_info: string, "
    "col_offset: int, end_col_offset: int>>")

# The severities and confidences the Python scanner is asked for.
BANDIT_SEVERITIES = ["HIGH", "MEDIUM"]
BANDIT_CONFIDENCES = ["HIGH", "MEDIUM"]


def first_or_text(doc: Column, key: str) -> Column:
    """A field of a variant that may be a list or a scalar: first element, else the text, else ''."""
    return F.coalesce(
        F.try_variant_get(doc, f"$.{key}[0]", "string"),
        F.nullif(F.try_variant_get(doc, f"$.{key}", "string"), F.lit("[]")),
        F.lit(""))


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _int(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))


def _results(reports: DataFrame, json_col: str, keep: tuple[str, ...], kind: str, partitions: int | None) -> DataFrame:
    """The result objects of all readable reports, one row each.  A report is parsed once, and only its wanted fields are taken out."""
    dealt = reports if partitions is None else reports.repartition(partitions)
    found = F.try_variant_get(F.try_parse_json(json_col), "$.results", kind)
    # The outer form: before the plain one, Spark would parse every report again in a filter against empty arrays.
    return dealt.select(*keep, F.explode_outer(found).alias("r")).filter("r IS NOT NULL").select(*keep, "r.*")


def ingest_semgrep(reports: DataFrame, json_col: str = "report", keep: tuple[str, ...] = (), *, partitions: int | None = None) -> DataFrame:
    """Semgrep reports to findings; missing keys take their defaults.  :func:`parse_errors` has the unreadable reports.

    ``partitions`` deals the reports out to that many tasks before they are parsed, for inputs that come in few large pieces.
    """
    rows = _results(reports, json_col, keep, _SEMGREP_RESULTS, partitions)
    meta = F.col("extra.metadata")
    out = rows.select(
        *keep,
        F.lit("semgrep").alias("scanner"),
        _text("check_id").alias("rule_id"),
        last_part(_text("check_id"), ".").alias("rule_name"),
        _text("extra.message").alias("message"),
        severity_map(F.col("extra.severity")).alias("severity"),
        confidence_map(F.try_variant_get(meta, "$.confidence", "string"), fold_case=True).alias("confidence"),
        first_or_text(meta, "cwe").alias("cwe_id"),
        first_or_text(meta, "owasp").alias("owasp"),
        _text("path").alias("file_path"),
        _int("start.line").alias("line_start"), _int("end.line").alias("line_end"),
        _int("start.col").alias("column_start"), _int("end.col").alias("column_end"),
        _text("extra.lines").alias("code_snippet"),
        F.to_json(F.struct(
            _text("extra.fingerprint").alias("fingerprint"),
            F.coalesce("extra.is_ignored", F.lit(False)).alias("is_ignored"),
            F.coalesce("extra.validation_state", F.lit("NO_VALIDATOR")).alias("validation_state"),
            meta.alias("metadata"))).alias("extras"))
    return out


def ingest_bandit(reports: DataFrame, json_col: str = "report", keep: tuple[str, ...] = (), *, partitions: int | None = None) -> DataFrame:
    """Bandit reports to findings; the end line is the start line.  A CWE given as an object yields its id.
    :func:`parse_errors` has the unreadable reports; ``partitions`` is that of :func:`ingest_semgrep`."""
    rows = _results(reports, json_col, keep, _BANDIT_RESULTS, partitions)
    cwe = F.coalesce(F.get_json_object("cwe", "$.id"), F.col("cwe"), F.lit(""))
    return rows.select(
        *keep,
        F.lit("bandit").alias("scanner"),
        _text("test_id").alias("rule_id"), _text("test_name").alias("rule_name"),
        _text("issue_text").alias("message"),
        F.coalesce("issue_severity", F.lit("MEDIUM")).alias("severity"),
        confidence_map(F.col("issue_confidence"), fold_case=False).alias("confidence"),
        cwe.alias("cwe_id"),
        _text("filename").alias("file_path"),
        _int("line_number").alias("line_start"), _int("line_number").alias("line_end"),
        _text("code").alias("code_snippet"),
        F.coalesce("issue_confidence", F.lit("MEDIUM")).alias("confidence_word"),
        F.to_json(F.struct(
            _text("more_info").alias("more_info"), _int("col_offset").alias("col_offset"),
            _int("end_col_offset").alias("end_col_offset"))).alias("extras"))


def ingest(reports: DataFrame, kind: str, json_col: str = "report", keep: tuple[str, ...] = ()) -> DataFrame:
    """Reports of a known kind to findings."""
    kinds = {"semgrep": ingest_semgrep, "bandit": ingest_bandit}
    if kind not in kinds:
        raise ValueError(f"unknown report kind: {kind}")
    return kinds[kind](reports, json_col, keep)


def bandit_floor(findings: DataFrame, *, severities=BANDIT_SEVERITIES, confidences=BANDIT_CONFIDENCES,
                 skip: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Keep the wanted severities and confidence words; skip or keep only some test ids."""
    out = findings.filter(F.col("severity").isin(severities) & F.col("confidence_word").isin(confidences))
    if skip:
        out = out.filter(~F.col("rule_id").isin(skip))
    if only:
        out = out.filter(F.col("rule_id").isin(only))
    return out


def unreadable(report: Column) -> Column:
    """Whether a report is null or no JSON."""
    return F.try_parse_json(report).isNull()


def parse_errors(reports: DataFrame, json_col: str = "report", keep: tuple[str, ...] = ()) -> DataFrame:
    """The reports that no finding can be read from, as rows: ``keep``, ``parse_error`` and the text's start."""
    return reports.filter(unreadable(F.col(json_col))).select(
        *keep, F.lit("report is not readable JSON").alias("parse_error"), F.substring(F.coalesce(json_col, F.lit("")), 1, 200).alias("excerpt"))


def report_metrics(reports: DataFrame, json_col: str = "report", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per report: findings, errors, total time and whether it could not be read, which counts as one error."""
    size = lambda key: F.greatest(F.coalesce(F.size(F.try_variant_get("doc", f"$.{key}", "array<variant>")), F.lit(0)), F.lit(0))
    bad = F.col("doc").isNull()
    return reports.select(*keep, F.try_parse_json(json_col).alias("doc")).select(
        *keep, bad.alias("parse_error"), size("results").cast("long").alias("finding_count"),
        F.when(bad, 1).otherwise(size("errors")).cast("long").alias("error_count"),
        F.coalesce(F.try_variant_get("doc", "$.time.total_time", "double"), F.lit(0.0)).alias("total_time"))


# Canonical column -> names tried in order, by presence.
ALIASES = {
    "cwe_id": ["cwe_id", "cwe"], "owasp_category": ["owasp", "owasp_category"], "rule_id": ["rule_id"],
    "rule_name": ["rule_name", "check_name"], "message": ["message", "issue_text"],
    "file_path": ["file_path", "path"], "line_start": ["line_start", "line"], "line_end": ["line_end", "line"],
    "column_start": ["column_start"], "column_end": ["column_end"], "code_snippet": ["code_snippet", "code"],
}


def unify(raw: DataFrame, scanner: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One scanner's rows to canonical findings with ids.

    A null is an absent key, so aliases fall back row by row; severity is upper-cased and defaults to
    MEDIUM, confidence to 0.7.
    """
    have = set(raw.columns)

    def pick(name: str) -> Column:
        default = F.lit(FINDING_COLUMNS[name][1])
        return F.coalesce(*[F.col(a) for a in ALIASES[name] if a in have], default).alias(name)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    meta = F.struct(
        F.lit(None).cast("array<string>").alias("original_scanners"),
        F.lit(None).cast("int").alias("duplicate_count"),
        given("config_type", F.lit(None).cast("string")).alias("config_type"),
        given("extras", F.lit(None).cast("string")).alias("extras"))
    passed = [F.col(c) for c in ("context_before", "context_after", "ai_patch", "patch_validated", "timestamp") if c in have]
    out = raw.select(
        *keep, F.lit(scanner).alias("scanner"),
        F.upper(given("severity", F.lit("MEDIUM"))).alias("severity"),
        given("confidence", F.lit(0.7)).alias("confidence"),
        *[pick(n) for n in ALIASES], *passed, meta.alias("metadata"))
    out = out.withColumn("id", finding_id(F.col("file_path"), F.col("line_start"), F.col("rule_id"), F.col("code_snippet")))
    return conform(out, keep)


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All scanners' findings in one table; a scanner without output adds nothing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
