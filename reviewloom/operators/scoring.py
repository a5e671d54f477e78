"""Weighted issue score and the pull-request decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.severity import WEIGHTS, severity_weight

# Default decision thresholds.
SCORE_THRESHOLD = 60
WEIGHTED_THRESHOLD = 8
MIN_SEVERITY = "warning"


def weighted_scores(issues: DataFrame, min_severity: str = MIN_SEVERITY) -> DataFrame:
    """Per review: summed weight and whether any issue reaches ``min_severity``.

    An unknown severity weighs nothing and is never actionable.
    """
    weight = severity_weight(F.col("severity"))
    return issues.groupBy("review_id").agg(
        F.sum(F.coalesce(weight, F.lit(0)).cast("bigint")).alias("weighted"),
        F.bool_or(F.coalesce(weight >= WEIGHTS[min_severity], F.lit(False))).alias("actionable"),
    )


def pr_decisions(
    reviews: DataFrame,
    issues: DataFrame,
    score_threshold: int = SCORE_THRESHOLD,
    weighted_threshold: int = WEIGHTED_THRESHOLD,
    min_severity: str = MIN_SEVERITY,
) -> DataFrame:
    """``reviews`` (with ``score``) extended by weighted, should_open_pr and reason."""
    joined = reviews.join(weighted_scores(issues, min_severity), "review_id", "left")
    weighted = F.coalesce(F.col("weighted"), F.lit(0).cast("bigint"))
    return (
        joined.withColumn("weighted", weighted)
        .withColumn("actionable", F.coalesce("actionable", F.lit(False)))
        .withColumn("should_open_pr", _opens(score_threshold, weighted_threshold))
        .withColumn("reason", _reason(score_threshold, weighted_threshold))
        .drop("actionable")
    )


def _low_score(threshold: int) -> Column:
    return F.coalesce(F.col("score") < threshold, F.lit(False))


def _opens(score_threshold: int, weighted_threshold: int) -> Column:
    """A review without a score (nothing changed) never opens a pull request."""
    bad = _low_score(score_threshold) | (F.col("weighted") >= weighted_threshold)
    return F.col("score").isNotNull() & F.col("actionable") & bad


def _reason(score_threshold: int, weighted_threshold: int) -> Column:
    # The reasons.
    return (
        F.when(~F.col("actionable"), "no error/warning-level issues found")
        .when(F.col("score").isNull(), "no score")
        .when(
            _low_score(score_threshold),
            F.format_string(f"health score %d is below threshold {score_threshold}", "score"),
        )
        .when(
            F.col("weighted") >= weighted_threshold,
            F.format_string(
                f"weighted issue score %d is at/above threshold {weighted_threshold}", "weighted"
            ),
        )
        .otherwise("issues present but under both thresholds")
    )
