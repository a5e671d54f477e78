"""Automatic-fix plan: decision, fix prompts, parsed fixes and pull-request payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import short_sha
from reviewloom.operators.responses import parse_fixes
from reviewloom.operators.scoring import pr_decisions
from reviewloom.plans.prompts import fix_prompts

# Names and texts of a fix pull request.
BRANCH_PREFIX = "ai-review-fixes/"
COMMIT_TAIL = "\n\nAutomated fixes generated from an AI code review."
BODY_NOTE = (
    "\n\n---\n_Opened automatically by the AI code review pipeline because this review's "
    "findings crossed the auto-fix threshold._\n\n**Files changed:**\n"
)
NO_TOKEN = "no githubToken with write access provided"
NO_FIXES = "AI did not return any safe fixes"


def pr_payloads(fixes: DataFrame) -> DataFrame:
    """Branch, commit message and body of each fix pull request.

    ``fixes`` has ``review_id, head_sha, base_branch, epoch_ms, pr_title, pr_body, fixes``;
    the clock comes in as a column so a rerun gives the same payload.
    """
    entry = F.transform(
        "fixes",
        lambda f: F.concat(F.lit("- `"), f["file"], F.lit("` — "), f["explanation"]),
    )
    return fixes.where(F.size("fixes") > 0).select(
        "review_id",
        F.col("pr_title").alias("title"),
        F.concat(
            F.lit(BRANCH_PREFIX), F.coalesce(short_sha(F.col("head_sha")), F.lit("")), F.lit("-"),
            F.col("epoch_ms").cast("string"),
        ).alias("branch"),
        F.col("base_branch"),
        F.concat(F.lit("fix: "), "pr_title", F.lit(COMMIT_TAIL)).alias("commit_message"),
        F.concat("pr_body", F.lit(BODY_NOTE), F.array_join(entry, "\n")).alias("body"),
        F.size("fixes").alias("files_changed"),
    )


def fix_candidates(reviews: DataFrame, issues: DataFrame, **thresholds) -> DataFrame:
    """Reviews that deserve a fix, with the reason; a token is needed to go on."""
    decided = pr_decisions(reviews, issues, **thresholds)
    return decided.withColumn("can_write", F.coalesce("has_token", F.lit(False)))


def fix_requests(candidates: DataFrame, issues: DataFrame, files: DataFrame) -> DataFrame:
    """Prompts of the reviews that get a fix pass."""
    chosen = candidates.where(F.col("should_open_pr") & F.col("can_write"))
    return fix_prompts(chosen.select("review_id", "repo_id", "repo_url"), issues, files)


def fix_outcomes(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """``review_id, ready, outcome``: the decision's reason, a missing token, or no fixes.

    ``responses`` holds the fix-pass answers (``review_id, text``).
    """
    # Moved to their review before the parse, not after it, so few file splits do not mean few tasks.
    parsed = parse_fixes(responses.repartition("review_id")).select("review_id", F.size("fixes").alias("n_fixes"))
    joined = candidates.join(parsed, "review_id", "left")
    wanted = F.col("should_open_pr")
    has_fixes = F.coalesce(F.col("n_fixes") > 0, F.lit(False))
    return joined.select(
        "review_id",
        (wanted & F.col("can_write") & has_fixes).alias("ready"),
        F.when(~wanted, F.col("reason"))
        .when(~F.col("can_write"), NO_TOKEN)
        .when(~has_fixes, NO_FIXES)
        .otherwise(F.col("reason"))
        .alias("outcome"),
    )


def fix_plan(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Payloads of the candidates whose fix pass returned usable fixes."""
    chosen = candidates.where(F.col("should_open_pr") & F.col("can_write")).select(
        "review_id", "head_sha", "base_branch", "epoch_ms"
    )
    return pr_payloads(chosen.join(parse_fixes(responses), "review_id"))
