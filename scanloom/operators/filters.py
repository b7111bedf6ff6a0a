"""Finding lists as a viewer filters them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM"]


def view(findings: DataFrame, *, severities: list[str] | None = None, scanners: list[str] | None = None,
         show_fp: bool = False) -> DataFrame:
    """Severity and scanner selections (an empty list selects all); flagged rows hidden unless asked for."""
    severities = DEFAULT_SEVERITIES if severities is None else severities
    out = findings
    if severities:
        out = out.filter(F.col("severity").isin(severities))
    if scanners:
        out = out.filter(F.col("scanner").isin(scanners))
    return out if show_fp else out.filter(~F.col("is_false_positive"))


def distinct_scanners(findings: DataFrame) -> DataFrame:
    return findings.select("scanner").distinct()
