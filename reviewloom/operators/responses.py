"""Model responses: provider choice and parsing into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import json_values as J
from reviewloom.functions.severity import CATEGORIES, SEVERITIES, clamp_score, one_of
from reviewloom.functions.text import trimmed

# Fallbacks of the parsers and texts of the provider choice.
SUMMARY_CHARS = 300
DEFAULT_PR_TITLE = "Automated fixes from AI code review"
RATE_LIMIT_WORDS = r"rate limit|429"


def choose_provider(responses: DataFrame) -> DataFrame:
    """First attempt with non-blank text per review.

    Reviews where every attempt failed get ``error_code`` AI_UNAVAILABLE and the error
    of each attempt, at most a handful of providers per review.
    """
    answer = trimmed(F.col("text"))
    answered = F.coalesce(answer, F.lit("")) != ""
    message = F.coalesce("error", F.concat("provider", F.lit(" returned an empty response")))
    position = F.col("attempt_pos")
    picked = responses.groupBy("review_id").agg(
        F.min_by(
            F.struct(answer.alias("text"), F.col("provider").alias("provider_used")),
            F.when(answered, position),
        ).alias("chosen"),
        F.min_by(message, F.when(~answered, position)).alias("first_error"),
        F.max_by(message, F.when(~answered, position)).alias("last_error"),
        F.bool_or(~answered & is_rate_limited()).alias("rate_limited"),
    )
    return picked.select(
        "review_id", "chosen.*", "first_error", "last_error", "rate_limited",
        F.when(F.col("chosen").isNull(), "AI_UNAVAILABLE").alias("error_code"),
    )


def is_rate_limited() -> Column:
    said = F.lower(F.coalesce("error", F.lit(""))).rlike(RATE_LIMIT_WORDS)
    return said | F.coalesce(F.col("status") == 429, F.lit(False))


def _with_entries(responses: DataFrame, name: str, of: str = "variant") -> DataFrame:
    """Adds the parsed document and its list member ``entries`` (null without a list)."""
    parsed = J.with_document(responses, "text", "d")
    entries = F.when(F.col("d.root") == "{", J.array_field(F.col("d.doc"), name, of))
    return parsed.withColumn("entries", entries)


def _has_null_entry() -> Column:
    """An issue list with a literal null cannot be reported."""
    return F.coalesce(F.exists("entries", F.is_variant_null), F.lit(False))


def parse_reviews(responses: DataFrame) -> DataFrame:
    """One row per response: ``summary, score, issue_count`` or ``parse_error``.

    Text without a JSON object or array becomes the summary itself, cut to 300 characters.
    """
    doc, root, bad = F.col("d.doc"), F.col("d.root"), F.col("__bad")
    keep = [c for c in responses.columns if c != "text"]
    structured = doc.isNotNull() & root.isin("{", "[")
    summary = F.when(
        structured, F.coalesce(J.text_field(doc, "summary"), F.lit(""))
    ).otherwise(F.substring("text", 1, SUMMARY_CHARS))
    score = clamp_score(F.when(root == "{", J.number_field(doc, "score")))
    # Only what readers filter on is kept from being copied; a member that none reads is not looked up.
    rows = J.computed_once(_with_entries(responses, "issues"), "__bad", _has_null_entry())
    return rows.select(
        *keep,
        F.when(~bad, summary).alias("summary"),
        F.when(~bad, score).alias("score"),
        F.when(~bad, F.coalesce(F.size("entries"), F.lit(0))).alias("issue_count"),
        F.when(bad, "INVALID_ISSUE").alias("parse_error"),
    )


def parse_issues(responses: DataFrame, *keys: str) -> DataFrame:
    """Issues of every response in list order, each field coerced to its type."""
    item = F.col("item")
    usable = F.when(~_has_null_entry(), F.col("entries"))
    rows = (
        _with_entries(responses, "issues")
        .select(*keys, F.posexplode_outer(usable).alias("seq", "item"))
        .where(F.col("seq").isNotNull())
    )
    return rows.select(
        *keys,
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(J.text_field(item, "file"), F.lit("unknown")).alias("file"),
        J.number_field(item, "line").cast("int").alias("line"),
        one_of(J.text_field(item, "severity"), SEVERITIES, "info").alias("severity"),
        one_of(J.text_field(item, "category"), CATEGORIES, "lint").alias("category"),
        F.coalesce(J.text_field(item, "message"), F.lit("")).alias("message"),
        F.coalesce(J.text_field(item, "suggestion"), F.lit("")).alias("suggestion"),
    )


def parse_fixes(responses: DataFrame) -> DataFrame:
    """``pr_title, pr_body, fixes`` per response; only fixes with a string file and
    content are kept."""
    doc = F.col("d.doc")
    keep = [c for c in responses.columns if c != "text"]

    def shaped(fix: Column) -> Column:
        return F.struct(
            J.text_value(fix["file"]).alias("file"),
            J.text_value(fix["newContent"]).alias("new_content"),
            F.coalesce(J.text_value(fix["explanation"]), F.lit("")).alias("explanation"),
        )

    fixes = F.filter(
        F.transform("entries", shaped),
        lambda f: f["file"].isNotNull() & f["new_content"].isNotNull(),
    )
    empty = F.array().cast("array<struct<file:string,new_content:string,explanation:string>>")
    listed = _with_entries(responses, "fixes", "struct<file: variant, newContent: variant, explanation: variant>")
    rows = J.computed_once(listed, "fixes", F.coalesce(fixes, empty))
    return rows.select(
        *keep,
        F.coalesce(J.text_field(doc, "prTitle"), F.lit(DEFAULT_PR_TITLE)).alias("pr_title"),
        F.coalesce(J.text_field(doc, "prBody"), F.lit("")).alias("pr_body"),
        "fixes",
    )
