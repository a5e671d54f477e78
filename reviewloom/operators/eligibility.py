"""Repository eligibility: metadata warnings, rule chain, size gate and API status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import megabytes

# Limits on repository size (KB) and remaining API calls.
SIZE_WARNING_KB = 500 * 1024
SIZE_LIMIT_KB = 200 * 1024
MIN_REMAINING = 10

# Status rules per endpoint, first match wins. A rule is
# (lowest status, highest status, code, served status or None for the original one).
STATUS_RULES = {
    "rate_limit": ((400, None, "RATE_LIMIT_CHECK_FAILED", None),),
    "metadata": (
        (404, 404, "REPO_NOT_FOUND", 404),
        (401, 401, "TOKEN_INVALID", 401),
        (403, 403, "TOKEN_FORBIDDEN", 403),
        (400, None, "GITHUB_API_ERROR", None),
    ),
    "commits": ((409, 409, "REPO_EMPTY", 422), (400, None, "COMMIT_CHECK_FAILED", None)),
    "head": ((404, 404, "BRANCH_NOT_FOUND", 404), (400, None, "HEAD_LOOKUP_FAILED", None)),
    "compare": ((404, 404, "BASE_NOT_COMPARABLE", 404), (400, None, "COMPARE_FAILED", None)),
    "zipball": (
        (404, 404, "REPO_NOT_FOUND", 404),
        (403, 403, "DOWNLOAD_FORBIDDEN", 403),
        (400, None, "DOWNLOAD_FAILED", None),
    ),
}

# Warning texts.
ARCHIVED = "Repository is archived. Review results may be outdated."
DISABLED = "Repository is disabled on GitHub."
FORK = "Repository is a fork. Consider reviewing the upstream source of truth."


def _status_match(endpoint: Column, status: Column, pick) -> Column:
    result = F.lit(None)
    for name, rules in reversed(list(STATUS_RULES.items())):
        for low, high, code, served in reversed(rules):
            test = (endpoint == name) & (status >= low)
            if high is not None:
                test = test & (status <= high)
            result = F.when(test, pick(code, served)).otherwise(result)
    return result


def api_error_code(endpoint: Column, status: Column) -> Column:
    return _status_match(endpoint, status, lambda code, _: F.lit(code))


def api_error_status(endpoint: Column, status: Column) -> Column:
    return _status_match(
        endpoint, status, lambda _, served: F.lit(served) if served is not None else status
    )


def classify_api_calls(calls: DataFrame) -> DataFrame:
    """``endpoint, http_status`` extended by ``error_code`` and ``error_status``."""
    endpoint, status = F.col("endpoint"), F.col("http_status")
    return calls.withColumn("error_code", api_error_code(endpoint, status)).withColumn(
        "error_status", api_error_status(endpoint, status).cast("int")
    )


def metadata_warnings() -> Column:
    """``array<struct<code, message>>`` in fixed order, from a repo_metadata row."""
    size = F.col("size_kb")

    def warn(test: Column, code: str, message: Column) -> Column:
        return F.when(
            F.coalesce(test, F.lit(False)),
            F.struct(F.lit(code).alias("code"), message.alias("message")),
        )

    large = F.concat(
        F.lit("Repository size is approximately "), megabytes(size, 1),
        F.lit(" MB (GitHub metadata). Large repos may be slow to process."),
    )
    return F.array_compact(
        F.array(
            warn(F.col("archived"), "REPO_ARCHIVED", F.lit(ARCHIVED)),
            warn(size > SIZE_WARNING_KB, "REPO_LARGE", large),
            warn(F.col("disabled"), "REPO_DISABLED", F.lit(DISABLED)),
            warn(F.col("fork"), "REPO_FORK", F.lit(FORK)),
        )
    )


def eligibility_code(min_remaining: int = MIN_REMAINING) -> Column:
    """First failing rule of a repo_metadata row, null when the repository is eligible.

    The budget column is tested before and after the metadata rules because the caller
    may ask for a higher minimum than the built-in one.
    """
    remaining = F.col("rate_remaining")
    status = F.col("http_status")
    return F.coalesce(
        F.when(remaining < MIN_REMAINING, "RATE_LIMIT_LOW"),
        api_error_code(F.lit("metadata"), status),
        F.when(F.col("size_kb") == 0, "REPO_EMPTY"),
        F.when(~F.coalesce("has_commits", F.lit(False)), "REPO_EMPTY"),
        F.when(F.coalesce("default_branch", F.lit("")) == "", "DEFAULT_BRANCH_MISSING"),
        F.when(remaining < min_remaining, "RATE_LIMIT_LOW"),
    )


def eligibility_message() -> Column:
    """Text for the code in column ``eligibility_code``."""
    # The messages.
    code = F.col("eligibility_code")
    return (
        F.when(
            code == "RATE_LIMIT_LOW",
            F.format_string(
                "GitHub API rate limit is too low (%d requests remaining). Try again later.",
                "rate_remaining",
            ),
        )
        .when(
            code == "REPO_NOT_FOUND",
            F.when(
                F.col("has_token"),
                "Repository not found or your token does not have access to it.",
            ).otherwise("Repository not found. Private repositories require a GitHub token."),
        )
        .when(code == "TOKEN_INVALID", "GitHub token is invalid or expired.")
        .when(
            code == "TOKEN_FORBIDDEN",
            F.coalesce(
                "response_message",
                F.lit("GitHub token lacks permission to access this repository."),
            ),
        )
        .when(code == "GITHUB_API_ERROR", "Failed to fetch repository metadata from GitHub.")
        .when(
            (code == "REPO_EMPTY") & (F.col("size_kb") == 0),
            "Repository appears to be empty (size is 0 KB).",
        )
        .when(code == "REPO_EMPTY", "Repository has no commits.")
        .when(code == "DEFAULT_BRANCH_MISSING", "Repository metadata is missing default_branch.")
    )


def check_eligibility(metadata: DataFrame, min_remaining: int = MIN_REMAINING) -> DataFrame:
    return (
        metadata.withColumn("eligibility_code", eligibility_code(min_remaining))
        .withColumn("eligibility_message", eligibility_message())
        .withColumn("visibility", F.when(F.col("private"), "private").otherwise("public"))
        .withColumn("warnings", metadata_warnings())
    )


def size_gate(requests: DataFrame) -> DataFrame:
    """Download gate on ``owner, repo, branch, size_kb``; adds gate_code and gate_message."""
    missing = F.lit(False)
    for name in ("owner", "repo", "branch"):
        missing = missing | (F.coalesce(F.col(name), F.lit("")) == "")
    too_large = F.col("size_kb") > SIZE_LIMIT_KB
    # The messages.
    return requests.withColumn(
        "gate_code", F.when(missing, "INVALID_INPUT").when(too_large, "REPO_TOO_LARGE")
    ).withColumn(
        "gate_message",
        F.when(missing, "owner, repo, and branch are required.").when(
            too_large,
            F.concat(
                F.lit("Repository is too large to download (≈"), megabytes(F.col("size_kb"), 0),
                F.lit(f" MB). Maximum allowed size is {SIZE_LIMIT_KB // 1024} MB."),
            ),
        ),
    )
