"""Labels, false-positive scores and the filter model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.falsepos import FEATURES, fp_features, fp_heuristic
from scanloom.session import materialise

# Thresholds, model size, and what labels do not record.
FP_THRESHOLD = 0.7
MIN_ROWS = 50
TREES = 100
# The deepest trees the library allows; its forests cannot be unlimited.
MAX_DEPTH = 30
SEED = 42
HOLDOUT = 0.2
# Share of features a split may choose from.  Labels leave five of the nine constant, and a draw of constants
# only would end the branch, so the share is larger than the usual square root.
FEATURE_SHARE = "0.75"
UNRECORDED = {"confidence": 0.7, "context_before": "", "context_after": "", "cwe_id": "", "rule_name": "", "line_start": 0, "line_end": 0}


def labelled_only(feedback: DataFrame) -> DataFrame:
    return feedback.filter(F.col("is_true_positive").isNotNull())


def feedback_stats(feedback: DataFrame) -> DataFrame:
    tp = F.col("is_true_positive").cast("int")
    return feedback.agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(tp == 1).alias("true_positives"),
        F.count_if(tp == 0).alias("false_positives"), F.count_if(tp.isNull()).alias("pending"))


def apply_feedback(feedback: DataFrame, updates: DataFrame, *, order: str) -> DataFrame:
    """Latest label per finding wins; updates without a stored row are ignored.

    ``updates`` = (finding_id, is_true_positive, <order>).  They shrink to one row per id before the join.
    """
    latest = updates.groupBy("finding_id").agg(F.max_by("is_true_positive", order).alias("new_label"))
    return (feedback.join(latest, "finding_id", "left")
            .withColumn("is_true_positive", F.coalesce("new_label", "is_true_positive")).drop("new_label"))


def score_fp(findings: DataFrame, model: PipelineModel | None = None, *, threshold: float = FP_THRESHOLD) -> DataFrame:
    """Adds ``fp_confidence`` and ``is_false_positive`` (strictly above the threshold); the rule-based estimate
    stands in when there is no model."""
    if model is None:
        scored = findings.withColumn("fp_confidence", fp_heuristic())
    else:
        given = model.transform(with_features(findings))
        scored = (given.withColumn("fp_confidence", vector_to_array("probability")[1])
                  .drop(*FEATURES, "features", "rawPrediction", "probability", "prediction"))
    return scored.withColumn("is_false_positive", F.col("fp_confidence") > threshold)


def drop_false_positives(scored: DataFrame, *, threshold: float = FP_THRESHOLD, enabled: bool = True) -> DataFrame:
    """Keep unless flagged and strictly above the second threshold."""
    if not enabled:
        return scored
    return scored.filter(~(F.col("is_false_positive") & (F.col("fp_confidence") > threshold)))


def with_features(findings: DataFrame) -> DataFrame:
    return findings.withColumns(fp_features())


def training_rows(feedback: DataFrame, findings: DataFrame | None = None, key: str = "finding_id") -> DataFrame:
    """Labelled rows with features and ``label`` (1 = false positive).

    Labels do not record confidence, context, weakness or lines; these get constants.  With the full ``findings``
    they come from there, by id; a label whose finding is gone keeps the constants, and of several findings of one
    id the one first in order of these columns stands.
    """
    rows = labelled_only(feedback)
    if findings is None:
        rows = rows.withColumns({c: F.lit(v) for c, v in UNRECORDED.items()})
    else:
        full = findings.groupBy(F.col("id").alias(key)).agg(F.min(F.struct(*UNRECORDED)).alias("__full"))
        rows = rows.drop(*UNRECORDED).join(full, key, "left")
        rows = rows.withColumns({c: F.coalesce(F.col("__full")[c], F.lit(v)) for c, v in UNRECORDED.items()}).drop("__full")
    text = {c: F.coalesce(c, F.lit("")) for c in ("code_snippet", "message")}
    label = F.when(F.col("is_true_positive").cast("int") == 0, 1.0).otherwise(0.0)
    return with_features(rows.withColumns(text)).withColumn("label", label)


def split_rows(rows: DataFrame, key: str = "finding_id", holdout: float = HOLDOUT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Stable split by a hash of the id: the same row always lands on the same side."""
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1000))
    cut = int(holdout * 1000)
    return rows.filter(bucket >= cut), rows.filter(bucket < cut)


def confusion(predicted: DataFrame) -> DataFrame:
    """(label, prediction, n): at most four rows, whatever the input."""
    return predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def evaluate(predicted: DataFrame) -> DataFrame:
    """Accuracy, support-weighted precision and recall from the confusion counts."""
    c = confusion(predicted)
    sides = (c.select(F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit")))).alias("e")).select("e.*")
        .groupBy("cls").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit")))
    part = lambda whole: F.when(F.col(whole) > 0, F.col("hit") / F.col(whole)).otherwise(F.lit(0.0))
    return sides.agg(
        F.sum("support").alias("samples"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        (F.sum(part("guessed") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(part("support") * F.col("support")) / F.sum("support")).alias("recall"))


def fp_pipeline(trees: int = TREES, seed: int = SEED, max_depth: int = MAX_DEPTH) -> Pipeline:
    """Features to forest.  ``max_depth`` defaults to the most the library allows, since trees should grow until pure."""
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"),
                            RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=max_depth, featureSubsetStrategy=FEATURE_SHARE)])


def train_fp(feedback: DataFrame, *, findings: DataFrame | None = None, min_rows: int = MIN_ROWS,
             trees: int = TREES, seed: int = SEED, max_depth: int = MAX_DEPTH) -> tuple[PipelineModel | None, DataFrame]:
    """(model, one-row report).  Too few labels: (None, status ``insufficient_data``)."""
    key = "finding_id"
    # Nine numbers and a label per row, kept once: the forest passes over them many times.
    rows = materialise(training_rows(feedback, findings, key).select(key, "label", *FEATURES), "training")
    n = rows.count()
    if n < min_rows:
        report = labelled_only(feedback).agg(F.lit("insufficient_data").alias("status"), F.count(F.lit(1)).alias("samples"))
        return None, report
    train, held_out = split_rows(rows, key)
    model = fp_pipeline(trees, seed, max_depth).fit(train)
    scores = evaluate(model.transform(held_out)).drop("samples")
    report = scores.select(F.lit("trained").alias("status"), F.lit(n).cast("bigint").alias("samples"), "accuracy", "precision", "recall")
    return model, report


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
