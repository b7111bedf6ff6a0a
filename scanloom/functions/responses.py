"""Reading model answers: fenced code, refusals, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Refusal marker, chatter prefixes, plan defaults.
REFUSAL = "UNABLE_TO_FIX"
CHATTER = ["Here is", "The fix", "Fixed code", "Below is"]
FALLBACK_STRATEGY = "Apply secure coding pattern"
FALLBACK_STEPS = ["Identify vulnerability", "Apply fix", "Verify"]
FALLBACK_CRITERIA = "No vulnerability flagged on rescan"
DEFAULT_COMPLEXITY = "medium"

FENCED = r"(?s)```(?:\w+)?\n(.*?)\n```"
PLAN_SCHEMA = ("root_cause string, fix_strategy string, steps array<string>, estimated_complexity string, "
               "potential_side_effects array<string>, success_criteria string")


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extract_code(response: Column) -> Column:
    """First fenced block, or the whole answer, trimmed."""
    return strip(F.when(response.rlike(FENCED), F.regexp_extract(response, FENCED, 1)).otherwise(response))


def extract_patch(response: Column) -> Column:
    """First fenced block; a refusal gives ''; without a block, the answer minus chatter lines."""
    block = strip(F.regexp_extract(response, FENCED, 1))
    lines = F.filter(F.split(response, "\n", -1), lambda ln: ~_starts_with_any(strip(ln), CHATTER))
    plain = F.when(strip(response).startswith(REFUSAL), "").otherwise(strip(F.array_join(lines, "\n")))
    return (F.when(response.rlike(FENCED), F.when(block.startswith(REFUSAL), "").otherwise(block))
            .otherwise(plain))


def _starts_with_any(text: Column, prefixes: list[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | text.startswith(p)
    return cond


def parse_plan(response: Column, message: Column) -> Column:
    """Plan struct from the text between the first '{' and the last '}'.

    Fields that are missing get their default; when there is no readable object, the fixed fallback plan.
    """
    text = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    plan = F.from_json(text, PLAN_SCHEMA, {"mode": "PERMISSIVE"})
    readable = (text != "") & F.try_parse_json(text).isNotNull()

    def field(name: str, default: Column, fallback: Column) -> Column:
        return F.when(readable, F.coalesce(plan[name], default)).otherwise(fallback).alias(name)

    none = F.array().cast("array<string>")
    return F.struct(
        field("root_cause", F.lit(""), message),
        field("fix_strategy", F.lit(""), F.lit(FALLBACK_STRATEGY)),
        field("steps", none, F.array(*[F.lit(s) for s in FALLBACK_STEPS])),
        field("estimated_complexity", F.lit(DEFAULT_COMPLEXITY), F.lit(DEFAULT_COMPLEXITY)),
        field("potential_side_effects", none, none),
        field("success_criteria", F.lit(""), F.lit(FALLBACK_CRITERIA)),
    )


def parse_responses(answers: DataFrame, response: str = "response", message: str = "message") -> DataFrame:
    """Answers with ``patch``, ``code`` and ``plan`` read from the response text."""
    r = F.col(response)
    return answers.withColumns({"patch": extract_patch(r), "code": extract_code(r), "plan": parse_plan(r, F.col(message))})
