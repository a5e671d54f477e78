"""Review history: latest rows, pointers, registration and integrity audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import non_blank
from reviewloom.operators.ranking import SLICE_ROWS, carried_forward, keep_first, numbered, top_k


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("review_id")]


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return keep_first(reviews, ["repo_id"], newest_first())


def recent_reviews(reviews: DataFrame, k: int) -> DataFrame:
    """Newest k reviews per repository; ``age`` 1 is the latest."""
    return top_k(reviews, ["repo_id"], newest_first(), k, "age")


def last_reviewed_pointers(reviews: DataFrame) -> DataFrame:
    """Last reviewed commit and branch, derived from the append-only reviews."""
    newest = F.max_by(F.struct("head_sha", "branch"), F.struct("created_at", "review_id"))
    return (
        reviews.groupBy("repo_id").agg(newest.alias("p"))
        .select(
            "repo_id",
            F.col("p.head_sha").alias("last_reviewed_sha"),
            F.col("p.branch").alias("last_reviewed_branch"),
        )
    )


def with_round_numbers(
    reviews: DataFrame, slice_rows: int | None = SLICE_ROWS, **options
) -> DataFrame:
    """Adds ``round_no`` per repository; counted by day, and a long day in slices."""
    return numbered(
        reviews, ["repo_id"], ["created_at", "review_id"], F.to_date("created_at"), "round_no",
        slice_rows=slice_rows, **options,
    )


def with_previous_review(reviews: DataFrame, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Round number and the review before each review of the same repository."""
    return with_round_numbers(
        reviews, slice_rows, previous={"review_id": "previous_review_id", "score": "previous_score"}
    )


def with_carried_score(reviews: DataFrame, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Stored score: own score, else the last earlier one, else zero."""
    carried = carried_forward(
        reviews, ["repo_id"], ["created_at", "review_id"], F.to_date("created_at"),
        "score", "stored_score", slice_rows,
    )
    return carried.withColumn("stored_score", F.coalesce("stored_score", F.lit(0)))


def owned_requests(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """Requests (``repo_id``, ``user_id``) checked against ownership.

    Adds ``error``: REPOSITORY_NOT_FOUND where the repository is missing or not the user's.
    """
    owned = repositories.select("repo_id", "user_id", F.lit(True).alias("owned"))
    return (
        requests.join(owned, ["repo_id", "user_id"], "left")
        .withColumn("error", F.when(F.col("owned").isNull(), "REPOSITORY_NOT_FOUND"))
        .drop("owned")
    )


def repositories_of_user(repositories: DataFrame, user_id) -> DataFrame:
    return repositories.where(F.col("user_id") == user_id)


def review_history(reviews: DataFrame, requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """All reviews of the repositories the requesting users own (unordered)."""
    allowed = owned_requests(requests, repositories).where(F.col("error").isNull())
    return reviews.join(allowed.select("repo_id", "user_id").distinct(), "repo_id")


def sorted_newest_first(reviews: DataFrame) -> DataFrame:
    return reviews.orderBy("repo_id", *newest_first())


def attach_latest_review(requests: DataFrame, reviews: DataFrame, issues: DataFrame | None = None):
    """Requests with ``previous_review_id`` and ``previous_score`` (null for a first review)."""
    latest = latest_reviews(reviews).select(
        "repo_id",
        F.col("review_id").alias("previous_review_id"),
        F.col("score").alias("previous_score"),
    )
    joined = requests.join(latest, "repo_id", "left")
    if issues is None:
        return joined
    counts = issues.groupBy("review_id").agg(F.count(F.lit(1)).alias("previous_issues"))
    counts = counts.withColumnRenamed("review_id", "previous_review_id")
    return joined.join(counts, "previous_review_id", "left").fillna(0, ["previous_issues"])


def with_owner(repositories: DataFrame, users: DataFrame) -> DataFrame:
    """Repositories with the served user fields; a password column is never selected."""
    served = users.select("user_id", F.col("email").alias("owner_email"), F.col("name").alias("owner_name"))
    return repositories.join(served, "user_id", "left")


def with_repository(reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    return reviews.join(repositories.select("repo_id", "full_name", "user_id"), "repo_id")


def new_repositories(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates to append: unknown ``github_id`` only, the earliest of repeats,
    ``private`` defaulting to false."""
    first = keep_first(
        candidates.withColumn("private", F.coalesce("private", F.lit(False))),
        ["github_id"], [F.col("created_at"), F.col("repo_id")],
    )
    return first.join(existing.select("github_id"), "github_id", "left_anti")


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """Values that break a unique key, with their count."""
    return (
        table.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    parents = parent.select(F.col(parent_key).alias(key))
    return child.where(F.col(key).isNotNull()).join(parents, key, "left_anti")


def target_branch(branch: Column, last_reviewed: Column, default: Column) -> Column:
    return F.coalesce(non_blank(branch), last_reviewed, default)


def review_modes(requests: DataFrame, pointers: DataFrame) -> DataFrame:
    """Mode of each request (``repo_id, force_full, head_sha``) against the last pointer.

    ``base_sha`` is null for a full review.
    """
    joined = requests.join(pointers, "repo_id", "left")
    base = F.when(~F.coalesce("force_full", F.lit(False)), F.col("last_reviewed_sha"))
    return joined.withColumn("base_sha", F.nullif(base, F.lit(""))).withColumn(
        "mode",
        F.when(F.col("base_sha").isNull(), "full")
        .when(F.col("base_sha") == F.col("head_sha"), "unchanged")
        .otherwise("incremental"),
    )


def with_compare_fallback(modes: DataFrame) -> DataFrame:
    """Turns incremental requests whose base is gone (compare status 404) into full ones.

    Adds ``mode_error`` for any other failed comparison.
    """
    compared = F.col("mode") == "incremental"
    status = F.col("compare_status")
    gone = F.coalesce(compared & (status == 404), F.lit(False))
    failed = F.coalesce(compared & (status >= 400) & (status != 404), F.lit(False))
    marked = modes.withColumn("fell_back", gone).withColumn(
        "mode_error", F.when(failed, "COMPARE_FAILED")
    )
    fell_back = F.col("fell_back")
    return marked.withColumn("mode", F.when(fell_back, "full").otherwise(F.col("mode"))).withColumn(
        "base_sha", F.when(~fell_back, F.col("base_sha"))
    )
