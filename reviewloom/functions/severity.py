"""Severity, category and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies of the data model.
SEVERITIES = ("error", "warning", "info")
CATEGORIES = ("security", "lint", "style", "logic", "performance")

# Tool words that map to each severity (anything else is info).
ERROR_WORDS = ("error", "e", "critical", "fatal")
WARNING_WORDS = ("warning", "warn", "w", "style", "performance", "portability")

# Weights for the pull-request decision.
WEIGHTS = {"error": 3, "warning": 1, "info": 0}

# Lower bounds of the score bands, best first.
SCORE_BANDS = ((90, "Excellent"), (70, "Good"), (50, "Fair"), (30, "Poor"))
SCORE_TONES = ((70, "ok"), (50, "warn"))


def normalize_severity(word: Column) -> Column:
    """Tool severity word to error, warning or info (case-insensitive, null is info)."""
    return normalize_lowered(F.lower(word))


def normalize_lowered(lowered: Column) -> Column:
    """The same of a word in lower case."""
    return (
        F.when(lowered.isin(*ERROR_WORDS), "error")
        .when(lowered.isin(*WARNING_WORDS), "warning")
        .otherwise("info")
    )


def normalize_severity_number(level: Column) -> Column:
    """Numeric tool severity: 2 is error, 1 is warning, everything else info."""
    return F.when(level == 2, "error").when(level == 1, "warning").otherwise("info")


def severity_rank(severity: Column) -> Column:
    """Sort position, worst first; unknown words come last."""
    rank = F.lit(len(SEVERITIES))
    for position, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, position).otherwise(rank)
    return rank


def severity_weight(severity: Column) -> Column:
    """Weight of one issue, null for a word outside the vocabulary."""
    weight = F.lit(None).cast("int")
    for name, value in WEIGHTS.items():
        weight = F.when(severity == name, value).otherwise(weight)
    return weight


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """``value`` where it is in the vocabulary, else ``default``."""
    return F.when(value.isin(*allowed), value).otherwise(default)


def issue_key(file, line, category, message, rule_id: Column | None = None) -> Column:
    """Identity of an issue: file, line (or ``?``), rule or category, message."""
    kind = [rule_id] if rule_id is not None else []
    return F.concat(
        file, F.lit("::"),
        F.coalesce(line.cast("string"), F.lit("?")), F.lit("::"),
        F.coalesce(*kind, category, F.lit("")), F.lit("::"),
        F.coalesce(message, F.lit("")),
    )


def clamp_score(number: Column) -> Column:
    """Round half up into 0..100; a missing number gives 50."""
    rounded = F.floor(number + F.lit(0.5))
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), rounded))
    return F.when(number.isNull(), 50).otherwise(clamped).cast("int")


def _banded(score: Column, bands, lowest: str) -> Column:
    label = F.lit(lowest)
    for bound, name in reversed(bands):
        label = F.when(score >= bound, name).otherwise(label)
    return label


def score_band(score: Column) -> Column:
    return _banded(score, SCORE_BANDS, "Critical")


def score_tone(score: Column) -> Column:
    return _banded(score, SCORE_TONES, "error")
