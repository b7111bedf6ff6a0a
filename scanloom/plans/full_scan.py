"""The whole scan as one lazy plan: scan, fuse, explain and patch, score, filter, check, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.prompts import prompt
from scanloom.functions.responses import extract_patch
from scanloom.operators import feedback, fusion, stats
from scanloom.operators.context import add_context
from scanloom.operators.plugins import ScannerRegistry, completion_stage
from scanloom.operators.repair import check_patches
from scanloom.session import materialise


def scan_and_fuse(files: DataFrame, *, target: str = "", registry: ScannerRegistry | None = None, mode: str = "exact") -> DataFrame:
    """Files to merged findings with context."""
    found = (registry or ScannerRegistry()).run(files).withColumn("target", F.lit(target))
    fused = fusion.fuse(found, mode=mode, order=("line_start", "scanner", "rule_id", "id"))
    return add_context(fused, files)


def explain_and_patch(findings: DataFrame, complete: Callable[[list[str]], list[str]], *, batch: int = 16, concurrency: int | None = None) -> DataFrame:
    """Findings with ``ai_analysis`` and ``ai_patch`` from a user's model client.

    Every distinct prompt is asked once, however many findings share it, and is known by its digest, so answers travel without their
    prompts.  The findings and the answers are kept as tables, so neither is made again when a later step is repeated.  Without an answer the explanation is the fixed text made from the scanner's own words, and there is no patch.
    """
    keyed = materialise(findings.withColumns({f"{kind}_key": F.sha2(prompt(kind), 256) for kind in ("explain", "patch")}), "asked")
    texts = keyed.select(F.explode_outer(F.array(*[F.struct(F.col(f"{kind}_key").alias("key"), prompt(kind).alias("prompt")) for kind in ("explain", "patch")])).alias("p"))
    answers = materialise(completion_stage(texts.select("p.*").dropDuplicates(["key"]), complete, key="key", batch=batch, concurrency=concurrency), "answers")
    # Answers first meet the distinct pairs of digests, so a finding with its texts is shuffled once for both.
    pairs = keyed.select("explain_key", "patch_key").distinct()
    for kind in ("explain", "patch"):
        pairs = pairs.join(answers.select(F.col("key").alias(f"{kind}_key"), F.col("response").alias(f"{kind}_answer")), f"{kind}_key", "left")
    out = (keyed.drop("ai_analysis", "ai_patch").join(pairs, ["explain_key", "patch_key"], "left")
           .withColumn("ai_analysis", F.coalesce("explain_answer", prompt("fallback")))
           .withColumn("ai_patch", F.coalesce(extract_patch(F.col("patch_answer")), F.lit(""))))
    return out.select(*[c for c in findings.columns if c in out.columns], *[c for c in ("ai_analysis", "ai_patch") if c not in findings.columns])


def finish(fused: DataFrame, *, model=None, fp_threshold: float = feedback.FP_THRESHOLD, check: bool = True) -> DataFrame:
    """Score, drop likely false positives, check patches."""
    kept = feedback.drop_false_positives(feedback.score_fp(fused, model), threshold=fp_threshold)
    if not check:
        return kept
    judged = check_patches(kept)
    has_patch = F.coalesce("ai_patch", F.lit("")) != ""
    return (judged.withColumn("patch_validated", has_patch & F.col("is_valid"))
            .withColumn("patch_validation_result", F.when(has_patch, F.col("check_message")).otherwise(""))
            .drop("is_valid", "check_message"))


def scored_statistics(findings: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """Raw findings to statistics of what is left after fusion and filtering."""
    fused = fusion.fuse_by_location(findings)
    kept = feedback.drop_false_positives(feedback.score_fp(fused))
    return stats.scan_statistics(kept, by=by)


def full_scan(files: DataFrame, *, target: str = "", complete: Callable[[list[str]], list[str]] | None = None, mode: str = "exact", model=None,
              registry: ScannerRegistry | None = None) -> DataFrame:
    """Files to the findings of a report: scanned, fused, with context, explained and patched if there is a client, without likely false
    positives, patches checked."""
    fused = scan_and_fuse(files, target=target, registry=registry, mode=mode)
    return finish(fused if complete is None else explain_and_patch(fused, complete), model=model)
