"""Repair attempts, provider chains, and patch checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.patches import native_verdict, python_syntax_error, python_verdict

MAX_ATTEMPTS = 3
# The default order of providers.
CHAIN = ["deepseek", "openai", "anthropic", "ollama"]


def provider_chain(preferred: str | None = None, available: list[str] | None = None) -> list[str]:
    """Provider order: the preferred one first if it is available, then the default order.  The local one always is."""
    usable = [p for p in CHAIN if available is None or p in available or p == "ollama"]
    return [p for p in usable if p == preferred] + [p for p in usable if p != preferred]


def repair_rollup(attempts: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, strategy: Column | None = None) -> DataFrame:
    """Attempts to one result per finding: the first success wins, else the last attempt is the best effort.

    ``attempts`` = (finding_id, attempt_num, validation_passed, patch).  Attempts after a success are not counted.
    """
    n = F.col("attempt_num")
    ok = F.col("validation_passed")
    rolled = attempts.filter(n <= max_attempts).groupBy("finding_id").agg(
        F.min(F.when(ok, n)).alias("first_ok"), F.max(n).alias("last_attempt"),
        F.min_by(F.when(ok, F.col("patch")), F.when(ok, n)).alias("ok_patch"), F.max_by("patch", n).alias("last_patch"))
    success = F.col("first_ok").isNotNull()
    plan = strategy if strategy is not None else F.lit("")
    return rolled.select(
        "finding_id", success.alias("success"),
        F.coalesce("first_ok", "last_attempt").alias("total_attempts"),
        F.when(success, F.col("ok_patch")).otherwise(F.col("last_patch")).alias("final_patch"),
        F.when(success, F.concat(F.lit("Fixed in "), F.col("first_ok").cast("string"), F.lit(" attempt(s). Strategy: "), plan))
        .when(F.coalesce("last_patch", F.lit("")) != "",
              F.lit(f"Best-effort patch after {max_attempts} attempts. Manual review required."))
        .otherwise("").alias("agent_reasoning"))


def fallback_select(calls: DataFrame, *, key: str = "finding_id", pos: str = "chain_pos") -> DataFrame:
    """First call in the chain that succeeded, per finding; null where all failed."""
    won = F.when(F.col("ok"), F.col(pos))
    return calls.groupBy(key).agg(
        F.min(won).alias("chosen_pos"), F.min_by("latency_ms", won).alias("chosen_latency_ms"),
        F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("ok_calls"))


def chain_position(provider: Column, chain: list[str]) -> Column:
    """0-based place of a provider in a chain; null when it is not in it."""
    at = F.array_position(F.array(*[F.lit(p) for p in chain]), provider)
    return F.when(at > 0, (at - 1).cast("int"))


def check_patches(findings: DataFrame, *, patch: str = "ai_patch", validators: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``is_valid`` and ``check_message``.

    One pass.  Routing and the danger list are native; the parser is handed the patch only where they leave it open,
    and a null, which costs it nothing, everywhere else.
    """
    col = F.col(patch)
    routed = findings.withColumn("__native", native_verdict(F.col("file_path"), col, validators or {}))
    parsed = routed.withColumn("__syntax", python_syntax_error(F.when(F.col("__native").isNull(), col)))
    judged = parsed.withColumn("__v", F.coalesce("__native", python_verdict(F.col("__syntax"), col)))
    return (judged.withColumn("is_valid", F.col("__v.is_valid")).withColumn("check_message", F.col("__v.message"))
            .drop("__native", "__syntax", "__v"))


def patched_only(findings: DataFrame) -> DataFrame:
    return findings.filter(F.coalesce("ai_patch", F.lit("")) != "")


def attach_verdicts(findings: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Findings with the verdict of their patch; without one, not validated.

    Ids repeat by design, so verdicts shrink to one row per id first: not valid if any of them is not.
    """
    worst = F.min(F.struct(F.col("is_valid").alias("ok"), F.col("check_message").alias("msg")))
    v = verdicts.groupBy(key).agg(worst.alias("__w")).select(key, F.col("__w.ok").alias("__ok"), F.col("__w.msg").alias("__msg"))
    return (findings.join(v, key, "left")
            .withColumn("patch_validated", F.coalesce("__ok", F.lit(False)))
            .withColumn("patch_validation_result", F.coalesce("__msg", F.lit(""))).drop("__ok", "__msg"))
