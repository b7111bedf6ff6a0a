"""Canonical table shapes.

One row per finding, one row per scan, one row per label.  Nothing nests at
rest except the small ``metadata`` struct; everything else is a flat column so
that Parquet can prune and push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The severity scale, highest first, and its ranks.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}

# The four scanners whose findings are unified.
SCANNERS = ["semgrep", "bandit", "secret_scanner", "config_audit"]

METADATA = T.StructType([
    T.StructField("original_scanners", T.ArrayType(T.StringType())),
    T.StructField("duplicate_count", T.IntegerType()),
    T.StructField("config_type", T.StringType()),
    T.StructField("extras", T.StringType()),  # scanner-specific JSON text
])

# column -> (type, default); a None default stays null.
FINDING_COLUMNS = {
    "id": (T.StringType(), ""),
    "scanner": (T.StringType(), ""),
    "severity": (T.StringType(), "MEDIUM"),
    "confidence": (T.DoubleType(), 0.7),
    "cwe_id": (T.StringType(), ""),
    "owasp_category": (T.StringType(), ""),
    "rule_id": (T.StringType(), ""),
    "rule_name": (T.StringType(), ""),
    "message": (T.StringType(), ""),
    "file_path": (T.StringType(), ""),
    "line_start": (T.IntegerType(), 0),
    "line_end": (T.IntegerType(), 0),
    "column_start": (T.IntegerType(), 0),
    "column_end": (T.IntegerType(), 0),
    "code_snippet": (T.StringType(), ""),
    "context_before": (T.StringType(), ""),
    "context_after": (T.StringType(), ""),
    "fix_suggestion": (T.StringType(), ""),
    "ai_analysis": (T.StringType(), ""),
    "ai_patch": (T.StringType(), ""),
    "patch_validated": (T.BooleanType(), False),
    "patch_validation_result": (T.StringType(), ""),
    "is_false_positive": (T.BooleanType(), False),
    "fp_confidence": (T.DoubleType(), 0.0),
    "metadata": (METADATA, None),
    "timestamp": (T.TimestampType(), None),
}

FINDING = T.StructType([T.StructField(n, t) for n, (t, _) in FINDING_COLUMNS.items()])

SCAN_HISTORY_COLUMNS = [
    "scan_id", "target_path", "scan_timestamp", "total_findings", "critical_count", "high_count",
    "medium_count", "low_count", "info_count", "validated_patches", "duration_seconds", "scanner_results",
]
FINDING_HISTORY_COLUMNS = [
    "scan_id", "rule_name", "severity", "cwe_id", "file_path", "patch_generated", "patch_validated",
]
FEEDBACK_COLUMNS = [
    "finding_id", "rule_name", "severity", "code_snippet", "message", "scanner", "is_true_positive",
]


def conform(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` to the canonical finding columns, in order, filling what is missing.

    ``keep`` names extra columns (a scan id, a target) carried in front.
    """
    have = set(df.columns)
    out = [F.col(c) for c in keep]
    for name, (dtype, default) in FINDING_COLUMNS.items():
        if name in have:
            col = F.col(name).cast(dtype)
            col = col if default is None else F.coalesce(col, F.lit(default))
        else:
            col = F.lit(default).cast(dtype)
        out.append(col.alias(name))
    return df.select(*out)
