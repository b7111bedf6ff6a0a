"""Findings analytics on Spark: DataFrame functions from source files to reports.

Public names load on first use, so Python tasks import only the module they run.
"""

from importlib import import_module

_PUBLIC = {
    "read_source_tree": "sources.files", "source_lines": "sources.files", "size_cap": "sources.files",
    "ingest": "sources.scanners", "unify": "sources.scanners", "union_findings": "sources.scanners",
    "scan_rules": "operators.scan", "scan_secrets": "operators.scan",
    "fuse": "operators.fusion", "cross_validate": "operators.fusion",
    "add_context": "operators.context", "line_context": "operators.context", "enclosing_function": "operators.context",
    "import_block": "operators.context",
    "enrich_cwe": "operators.enrich", "fix_example": "operators.enrich", "kb_search": "operators.enrich", "prompts": "operators.enrich",
    "price_calls": "operators.enrich", "estimate_cost": "operators.enrich", "token_usage": "operators.enrich", "pair_by_finding": "operators.enrich",
    "parse_responses": "functions.responses",
    "score_fp": "operators.feedback", "drop_false_positives": "operators.feedback", "train_fp": "operators.feedback",
    "apply_feedback": "operators.feedback", "feedback_stats": "operators.feedback",
    "check_patches": "operators.repair", "repair_rollup": "operators.repair", "fallback_select": "operators.repair",
    "scan_statistics": "operators.stats", "gate": "operators.stats", "severity_distribution": "operators.stats",
    "trend_summary": "operators.trends", "top_cwe": "operators.trends", "fix_rate_by_severity": "operators.trends", "recent_history": "operators.trends",
    "changed_files": "operators.incremental", "changed_stats": "operators.incremental", "compare_scans": "operators.incremental",
    "view": "operators.filters", "ScannerRegistry": "operators.plugins", "completion_stage": "operators.plugins",
    "record_scan": "sinks.history", "record_feedback": "sinks.history", "read_history": "sinks.history", "compact_history": "sinks.history",
    "report": "sinks.reports", "write_report": "sinks.reports", "register_reporter": "sinks.reports",
    "stream_scan": "streaming.streams", "stream_dedup": "streaming.streams", "stream_trend": "streaming.streams",
    "scan_and_fuse": "plans.full_scan", "finish": "plans.full_scan",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(name)
    return getattr(import_module(f"scanloom.{_PUBLIC[name]}"), name)
