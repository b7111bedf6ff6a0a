"""False-positive score: the rule-based estimate and the nine model features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.scalar import any_contains, lookup, severity_rank

# Weights, words and codes of the estimate.
PRONE_WORDS = ["eval", "exec", "pickle", "assert"]
SHORT_SNIPPET = 30
SCANNER_CODES = {"semgrep": 0, "bandit": 1, "codeql": 2, "fusion": 3}
FEATURES = ["f_severity", "f_confidence", "f_snippet_len", "f_message_len", "f_has_before", "f_has_after",
            "f_scanner", "f_cwe", "f_span"]


def fp_heuristic() -> Column:
    """0.5 plus the weights that apply, clamped to 0..1."""
    conf, sev = F.col("confidence"), F.col("severity")
    zero = F.lit(0.0)
    score = (F.when(conf >= 0.9, F.lit(-0.3)).when(conf <= 0.5, F.lit(0.3)).otherwise(zero)
             + F.when(sev == "CRITICAL", F.lit(-0.4)).when(sev == "INFO", F.lit(0.4)).otherwise(zero)
             + F.when(any_contains(F.lower("rule_name"), PRONE_WORDS), F.lit(0.2)).otherwise(zero)
             + F.when(F.length("code_snippet") < SHORT_SNIPPET, F.lit(0.15)).otherwise(zero)
             + F.when(F.col("scanner").contains("fusion"), F.lit(-0.25)).otherwise(zero))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + score))


def fp_features() -> dict[str, Column]:
    """The nine features as double columns, in model order."""
    has = lambda c: (F.length(c) > 0).cast("double")
    return {
        "f_severity": severity_rank(F.col("severity"), 2).cast("double"),
        "f_confidence": F.col("confidence").cast("double"),
        "f_snippet_len": F.length("code_snippet").cast("double"),
        "f_message_len": F.length("message").cast("double"),
        "f_has_before": has("context_before"),
        "f_has_after": has("context_after"),
        "f_scanner": lookup(F.substring_index("scanner", "(", 1), SCANNER_CODES, 0).cast("double"),
        "f_cwe": F.lower(F.coalesce("cwe_id", F.lit(""))).contains("cwe").cast("double"),
        "f_span": (F.col("line_end") - F.col("line_start") + 1).cast("double"),
    }
