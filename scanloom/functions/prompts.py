"""Prompt and fallback texts as column expressions over finding columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.scalar import (
    SEVERITY_ICONS, SEVERITY_WORDS, UNKNOWN_ICON, categorize_fix, detect_language, lookup, or_default, percent,
)

# The texts sent to a model, with {placeholders}.
PATCH_PROMPT = """# Vulnerability Remediation Task

## Vulnerability Details
- Severity: {severity} - {severity_words}
- Type: {rule_name}
- CWE: {cwe_or_na}
- Location: {file_path}:{line_start}
- Confidence: {confidence_percent}

## Problem Description
{message}

## Vulnerable Code
```
{code_snippet}
```

## Code Context (Before)
```
{context_before}
```

## Code Context (After)
```
{context_after}
```

## Task
Generate the secure fixed version of the vulnerable code section.
Replace ONLY the vulnerable lines while keeping the rest of the function/class intact.

## Additional Requirements
- Fix Type: {fix_type}
- Language: {language}
- Must preserve: original function signatures, variable names, and overall structure
"""

EXPLAIN_PROMPT = """# Security Vulnerability Analysis Request

## Vulnerability Information
- **Rule/Type**: {rule_name}
- **Severity**: {severity}
- **Confidence**: {confidence_percent}
- **CWE**: {cwe_or_unknown}
- **OWASP Category**: {owasp_or_unknown}
- **Location**: `{file_path}:{line_start}-{line_end}`

## Scanner Message
{message}

## Vulnerable Code
```
{code_snippet}
```

## Context (Before)
```
{context_before}
```

## Context (After)
```
{context_after}
```

## Task
Provide a comprehensive vulnerability analysis using the specified output structure.
Focus on helping the developer understand WHY this is dangerous and HOW to fix it.
"""

PLAN_PROMPT = """Analyze this vulnerability and create a repair plan:

Vulnerability: {rule_name}
Severity: {severity}
CWE: {cwe_id}
Message: {message}

Vulnerable code:
```
{code_snippet}
```

Context before:
```
{context_before}
```
"""

REPAIR_PROMPT = """## Vulnerability to Fix
Type: {rule_name} ({cwe_id})
Root Cause: {root_cause}
Fix Strategy: {fix_strategy}
Steps: {numbered_steps}

## Vulnerable Code
```
{code_snippet}
```

## Context
```
{context_before}
```
```
{context_after}
```
"""

REFLECT_PROMPT = """## Failed Patch
```
{failed_patch}
```

## Validation Error
{validation_error}

## Original Vulnerability
{message}

## Vulnerable Code
```
{code_snippet}
```

The patch above failed validation. Fix the issue in the patch and return a corrected version.
"""

FALLBACK_EXPLANATION = """## {icon} {rule_name}

**Severity**: {severity} | **Confidence**: {confidence_percent}

### Summary
{message}

### Location
`{file_path}:{line_start}`

### Vulnerable Code
```
{code_snippet}
```

### Recommended Action
Review the identified code and apply secure coding practices to remediate the vulnerability.
Refer to CWE {cwe_or_documentation} for specific guidance.

*Note: AI-powered detailed analysis temporarily unavailable. Using scanner-provided information.*
"""

TEMPLATES = {"patch": PATCH_PROMPT, "explain": EXPLAIN_PROMPT, "plan": PLAN_PROMPT, "repair": REPAIR_PROMPT,
             "reflect": REFLECT_PROMPT, "fallback": FALLBACK_EXPLANATION}


def _derived(name: str) -> Column:
    c = F.col
    made = {
        "severity_words": lambda: lookup(c("severity"), SEVERITY_WORDS, "Unknown"),
        "icon": lambda: lookup(c("severity"), SEVERITY_ICONS, UNKNOWN_ICON),
        "confidence_percent": lambda: percent(c("confidence")),
        "cwe_or_na": lambda: or_default(c("cwe_id"), "N/A"),
        "cwe_or_unknown": lambda: or_default(c("cwe_id"), "Unknown"),
        "cwe_or_documentation": lambda: or_default(c("cwe_id"), "documentation"),
        "owasp_or_unknown": lambda: or_default(c("owasp_category"), "Unknown"),
        "fix_type": lambda: categorize_fix(c("cwe_id"), c("message")),
        "language": lambda: detect_language(c("file_path")),
        "numbered_steps": lambda: numbered(c("steps")),
    }
    return made[name]() if name in made else c(name)


def numbered(steps: Column) -> Column:
    """One indented, numbered line per step."""
    return F.array_join(
        F.transform(steps, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s)), "\n")


def render(template: str) -> Column:
    """A template as one concat of literals and (null-safe) columns."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(F.coalesce(_derived(piece).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def prompt(kind: str) -> Column:
    """Column expression for one kind of text: patch, explain, plan, repair, reflect or fallback."""
    return render(TEMPLATES[kind])
