"""Scalar column expressions on findings; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.schemas import SEVERITY_RANK

# Scanner severities and confidence words.
SEMGREP_SEVERITY = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
CONFIDENCE_WORDS = {"HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.5}

# File extension to language name.
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "c": "C", "cpp": "C++",
    "go": "Go", "rb": "Ruby", "php": "PHP", "cs": "C#", "rs": "Rust",
}

# Icons and prompt wording per severity.
SEVERITY_ICONS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢", "INFO": "🔵"}
UNKNOWN_ICON = "⚪"
SEVERITY_WORDS = {
    "CRITICAL": "Critical - Immediate exploitation risk",
    "HIGH": "High - Likely exploitable",
    "MEDIUM": "Medium - Possible exploitation",
    "LOW": "Low - Difficult to exploit",
}

# Fix categories, tested in this order; words looked for in the CWE text, then in the message.
FIX_CATEGORIES = [
    ("Parameterized Query / Prepared Statement", ["sql"], ["sql"]),
    ("Output Encoding / Context-aware Escaping", ["xss"], ["xss", "cross-site"]),
    ("Input Validation / Sanitization", ["injection"], ["injection"]),
    ("Path Canonicalization / Validation", ["path"], ["traversal"]),
    ("Strong Cryptographic Primitive", ["crypto"], ["hash"]),
    ("Authentication / Session Hardening", ["auth"], ["session"]),
    ("Safe Deserialization / Type Whitelisting", ["deserialization"], []),
    ("Synchronization / Atomic Operations", ["race"], ["condition"]),
]
DEFAULT_FIX = "Input Validation / Secure API Usage"


def lookup(key: Column, table: dict, default) -> Column:
    """Constant dictionary lookup as one literal map access."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def any_contains(text: Column, words: list[str]) -> Column:
    """True when ``text`` contains one of the constant words."""
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def or_default(col: Column, default: str) -> Column:
    """Empty string counts as missing."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def severity_map(raw: Column) -> Column:
    """Scanner severity to the unified scale; a missing one counts as INFO, an unknown one as MEDIUM."""
    return lookup(F.upper(F.coalesce(raw, F.lit("INFO"))), SEMGREP_SEVERITY, "MEDIUM")


def confidence_map(raw: Column, *, fold_case: bool) -> Column:
    """Confidence word to number.  One scanner's words are folded to upper case first, the other's are not."""
    word = F.coalesce(raw, F.lit("MEDIUM"))
    return lookup(F.upper(word) if fold_case else word, CONFIDENCE_WORDS, 0.7)


def severity_rank(sev: Column, unknown: int = 0) -> Column:
    """4 for CRITICAL down to 0 for INFO."""
    return lookup(sev, SEVERITY_RANK, unknown)


def rule_name_of(rule_id: Column) -> Column:
    """Text after the first dot, or all of it."""
    return F.regexp_replace(rule_id, r"^[^.]*\.", "")


def rule_family_of(rule_id: Column) -> Column:
    """Text before the first dot."""
    return F.substring_index(rule_id, ".", 1)


def last_part(col: Column, sep: str) -> Column:
    return F.substring_index(col, sep, -1)


def detect_language(path: Column) -> Column:
    return lookup(F.lower(last_part(path, ".")), LANGUAGES, "Unknown")


def categorize_fix(cwe: Column, message: Column) -> Column:
    """First category whose words occur in the CWE or message text."""
    c, m = F.lower(F.coalesce(cwe, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    expr = F
    for label, in_cwe, in_message in FIX_CATEGORIES:
        expr = expr.when(any_contains(c, in_cwe) | any_contains(m, in_message), F.lit(label))
    return expr.otherwise(F.lit(DEFAULT_FIX))


def patch_status(patch: Column, validated: Column) -> Column:
    return (F.when(F.coalesce(patch, F.lit("")) == "", "No Patch")
            .when(validated, "Validated").otherwise("Unvalidated"))


def short_id(fid: Column) -> Column:
    return F.substring(fid, 1, 8)


def short_location(path: Column, line: Column) -> Column:
    return F.concat(last_part(path, "/"), F.lit(":"), line.cast("string"))


def percent(ratio: Column) -> Column:
    """0.85 -> '85%', rounding half to even as the reports print it."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))


def finding_id(path: Column, line: Column, rule_id: Column, snippet: Column) -> Column:
    """First 16 hex digits of sha256 over ``path:line:rule:snippet``; stable across runs and scans."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (path, line, rule_id, snippet)]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def markdown_to_html(text: Column) -> Column:
    """Bold, two header levels, inline code and line breaks, applied in that order."""
    t = F.regexp_replace(text, r"\*\*([^\n]+?)\*\*", "<strong>$1</strong>")
    t = F.regexp_replace(t, r"(?m)^### ([^\n]+)$", "<h3>$1</h3>")
    t = F.regexp_replace(t, r"(?m)^## ([^\n]+)$", "<h2>$1</h2>")
    t = F.regexp_replace(t, r"`([^`]+)`", "<code>$1</code>")
    return F.replace(t, F.lit("\n"), F.lit("<br>"))
