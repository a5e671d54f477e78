"""Review history, registry and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.views import oracle
from reviewloom.functions.text import display_date, short_sha
from reviewloom.operators import history
from reviewloom.plans.review import unchanged_reports
from reviewloom.session import scratch_dir
from reviewloom.sources.review_store import ReviewStore
from reviewloom.sources.samples import Samples


def _repositories(s: Samples):
    """Customers as repositories, their nation as the owning user."""
    return s.table("customer").selectExpr(
        "c_custkey AS repo_id", "c_nationkey AS user_id", "c_name AS full_name",
        "c_name AS github_id",
    )


def latest_review(spark, sf_dir):
    rows = history.latest_reviews(Samples(spark, sf_dir).reviews())
    return rows.select("repo_id", "review_id", "mode", "score")


def _store(spark, s: Samples) -> ReviewStore:
    """The sample reviews in a store, appended in two parts."""
    columns = "review_id bigint, repo_id bigint, created_at timestamp, mode string, score int"
    store = ReviewStore(spark, scratch_dir(spark, "review-store"), columns, buckets=8, slots=4)
    reviews = s.reviews().select("review_id", "repo_id", "created_at", "mode", "score")
    early = F.col("created_at") < F.lit("1995-07-01").cast("timestamp")
    store.append(reviews.where(early))
    store.append(reviews.where(~early))
    return store


def stored_latest_review(spark, sf_dir):
    """Latest reviews from the store: bucketed by repository, no exchange after the appends."""
    return _store(spark, Samples(spark, sf_dir)).latest().select("repo_id", "review_id", "mode", "score")


def stored_review_history(spark, sf_dir):
    """Histories of the requested repositories from the store; its rows stay where they are."""
    s = Samples(spark, sf_dir)
    rows = _store(spark, s).histories(s.view("requests"))
    return rows.select("repo_id", "review_id", "mode", "score")


def last_reviewed_pointer(spark, sf_dir):
    return history.last_reviewed_pointers(Samples(spark, sf_dir).reviews())


def review_history(spark, sf_dir):
    s = Samples(spark, sf_dir)
    requests = s.table("customer").selectExpr(
        "c_custkey AS repo_id", "CAST(c_custkey % 25 AS INT) AS user_id"
    )
    rows = history.review_history(s.reviews(), requests, _repositories(s))
    return history.sorted_newest_first(rows).select(
        "repo_id", "user_id", "review_id", "mode", display_date(F.col("created_at")).alias("shown_at")
    )


def review_rounds(spark, sf_dir):
    rows = history.with_previous_review(Samples(spark, sf_dir).reviews())
    return rows.select("review_id", "repo_id", "round_no", "previous_review_id", "previous_score")


# Repository 0 has every third event, all of one day, so its day is cut into many slices.
_HOT_EVENTS = (
    "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS repo_id",
    "event_id AS review_id",
    "CASE WHEN event_id % 3 = 0 THEN DATE '2024-01-01' ELSE CAST(ts AS DATE) END AS created_at",
    "CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS INT) END AS score",
)


def hot_day_rounds(spark, sf_dir):
    """Round numbers, rounds before and stored scores where one day of one repository is a third of all."""
    events = Samples(spark, sf_dir).table("events").selectExpr(*_HOT_EVENTS)
    rounds = history.with_previous_review(events, slice_rows=200)
    stored = history.with_carried_score(rounds, slice_rows=200)
    return stored.select("repo_id", "review_id", "round_no", "previous_review_id", "previous_score", "stored_score")


def attach_latest_review(spark, sf_dir):
    s = Samples(spark, sf_dir)
    requests = s.view("requests").select("repo_id")
    return history.attach_latest_review(requests, s.reviews(), s.issues())


def _modes(s: Samples):
    pointers = history.last_reviewed_pointers(s.reviews())
    shas = s.view("requests").join(
        pointers.select("repo_id", F.col("last_reviewed_sha").alias("sha")), "repo_id", "left"
    )
    requests = shas.withColumn(
        "head_sha", F.when(F.col("same_head"), F.col("sha")).otherwise(F.lit("new"))
    ).drop("sha")
    return history.review_modes(requests, pointers)


def mode_resolution(spark, sf_dir):
    return _modes(Samples(spark, sf_dir)).select("repo_id", "mode", "base_sha")


def not_comparable_fallback(spark, sf_dir):
    rows = history.with_compare_fallback(_modes(Samples(spark, sf_dir)))
    return rows.select("repo_id", "mode", "base_sha", "fell_back", "mode_error")


def target_branch(spark, sf_dir):
    s = Samples(spark, sf_dir)
    rows = s.view("requests").join(
        history.last_reviewed_pointers(s.reviews()), "repo_id", "left"
    )
    return rows.select(
        "repo_id",
        history.target_branch(
            F.col("branch"), F.col("last_reviewed_branch"), F.lit("trunk")
        ).alias("target_branch"),
        short_sha(F.col("last_reviewed_sha")).alias("short_sha"),
    )


def unchanged_report(spark, sf_dir):
    s = Samples(spark, sf_dir)
    latest = history.latest_reviews(s.reviews().select("review_id", "repo_id", "created_at"))
    previous = s.issues().join(latest, "review_id")
    requests = _modes(s).withColumn("review_id", -F.col("repo_id"))
    return unchanged_reports(requests, previous)


def owned_requests(spark, sf_dir):
    s = Samples(spark, sf_dir)
    requests = s.table("customer").selectExpr(
        "c_custkey + 3 AS repo_id", "CAST(c_custkey % 25 AS INT) AS user_id"
    )
    return history.owned_requests(requests, _repositories(s))


def owned_repos(spark, sf_dir):
    s = Samples(spark, sf_dir)
    rows = history.repositories_of_user(_repositories(s), 7)
    return rows.select("repo_id", "full_name", "user_id")


def repositories_with_owner(spark, sf_dir):
    s = Samples(spark, sf_dir)
    users = s.table("nation").selectExpr(
        "n_nationkey AS user_id", "lower(n_name) AS email", "n_name AS name"
    )
    rows = history.with_owner(_repositories(s), users)
    return rows.select("repo_id", "owner_email", "owner_name")


def reviews_with_repository(spark, sf_dir):
    s = Samples(spark, sf_dir)
    rows = history.with_repository(s.reviews(), _repositories(s))
    return rows.select("review_id", "repo_id", "full_name", "user_id")


def register_repos(spark, sf_dir):
    """Orders propose repositories by customer segment and nation; some are known already."""
    s = Samples(spark, sf_dir)
    candidates = s.table("orders").selectExpr(
        "concat('repo-', CAST(o_custkey % 500 AS STRING), '-', o_orderpriority) AS github_id",
        "o_orderkey AS repo_id", "o_orderdate AS created_at",
        "CASE WHEN o_orderkey % 3 = 0 THEN true END AS private",
    )
    existing = s.table("customer").selectExpr(
        "concat('repo-', CAST(c_custkey * 4 AS STRING), '-5-LOW') AS github_id"
    )
    return history.new_repositories(candidates, existing).select("github_id", "repo_id", "private")


def unique_audit(spark, sf_dir):
    users = Samples(spark, sf_dir).table("customer").selectExpr(
        "concat(c_mktsegment, '-', CAST(c_nationkey AS STRING)) AS email"
    )
    return history.duplicate_keys(users, "email")


def fk_audit(spark, sf_dir):
    """Reviews whose repository is missing from a registry that lists every ninth customer under another id."""
    s = Samples(spark, sf_dir)
    registry = s.table("customer").selectExpr(
        "CASE WHEN c_custkey % 9 = 0 THEN -1 - c_custkey ELSE c_custkey END AS repo_id"
    )
    reviews = s.table("orders").selectExpr("o_orderkey AS review_id", "o_custkey AS repo_id")
    return history.orphans(reviews, registry, "repo_id", "repo_id")


_POINTER = "p AS (SELECT repo_id, head_sha, branch, review_id FROM fx_reviews WHERE age = 1)"
_MODES = (
    _POINTER + ", q AS (SELECT r.repo_id, r.compare_status, "
    "CASE WHEN r.force_full THEN NULL ELSE p.head_sha END AS base_sha, "
    "CASE WHEN r.same_head THEN p.head_sha ELSE 'new' END AS head_sha "
    "FROM fx_requests r LEFT JOIN p ON p.repo_id = r.repo_id), "
    "m AS (SELECT *, CASE WHEN base_sha IS NULL THEN 'full' WHEN base_sha = head_sha THEN 'unchanged' "
    "ELSE 'incremental' END AS mode FROM q)"
)

QUERIES = {
    "latest_review": latest_review,
    "stored_latest_review": stored_latest_review,
    "stored_review_history": stored_review_history,
    "last_reviewed_pointer": last_reviewed_pointer,
    "review_history": review_history,
    "review_rounds": review_rounds,
    "hot_day_rounds": hot_day_rounds,
    "attach_latest_review": attach_latest_review,
    "mode_resolution": mode_resolution,
    "not_comparable_fallback": not_comparable_fallback,
    "target_branch": target_branch,
    "unchanged_report": unchanged_report,
    "owned_requests": owned_requests,
    "owned_repos": owned_repos,
    "repositories_with_owner": repositories_with_owner,
    "reviews_with_repository": reviews_with_repository,
    "register_repos": register_repos,
    "unique_audit": unique_audit,
    "fk_audit": fk_audit,
}

ORACLES = {
    "latest_review": oracle(
        "SELECT repo_id, review_id, mode, score FROM fx_reviews WHERE age = 1", "reviews"),
    "stored_latest_review": oracle(
        "SELECT repo_id, review_id, mode, score FROM fx_reviews WHERE age = 1", "reviews"),
    "stored_review_history": oracle(
        "SELECT repo_id, review_id, mode, score FROM fx_reviews WHERE repo_id IN (SELECT repo_id FROM fx_requests)",
        "reviews", "requests"),
    "last_reviewed_pointer": oracle(
        "SELECT repo_id, head_sha AS last_reviewed_sha, branch AS last_reviewed_branch "
        "FROM fx_reviews WHERE age = 1", "reviews"),
    "review_history": oracle(
        "SELECT v.repo_id, c.c_nationkey AS user_id, v.review_id, v.mode, "
        "strftime(v.created_at, '%b %-d, %H:%M') AS shown_at FROM fx_reviews v "
        "JOIN customer c ON c.c_custkey = v.repo_id WHERE c.c_nationkey = c.c_custkey % 25", "reviews"),
    "review_rounds": oracle(
        "SELECT review_id, repo_id, round_no, lag(review_id) OVER w AS previous_review_id, "
        "lag(score) OVER w AS previous_score FROM fx_reviews "
        "WINDOW w AS (PARTITION BY repo_id ORDER BY round_no)", "reviews"),
    "hot_day_rounds": (
        f"WITH e AS (SELECT {', '.join(_HOT_EVENTS)} FROM events) SELECT repo_id, review_id, "
        "row_number() OVER w AS round_no, lag(review_id) OVER w AS previous_review_id, "
        "lag(score) OVER w AS previous_score, coalesce(last_value(score IGNORE NULLS) OVER (PARTITION BY repo_id "
        "ORDER BY created_at, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS stored_score "
        "FROM e WINDOW w AS (PARTITION BY repo_id ORDER BY created_at, review_id)"
    ),
    "attach_latest_review": oracle(
        "SELECT r.repo_id, v.review_id AS previous_review_id, v.score AS previous_score, "
        "(SELECT count(*) FROM fx_findings f WHERE f.review_id = v.review_id) AS previous_issues "
        "FROM fx_requests r LEFT JOIN fx_reviews v ON v.repo_id = r.repo_id AND v.age = 1",
        "reviews", "findings", "requests"),
    "mode_resolution": oracle(
        "SELECT repo_id, mode, base_sha FROM m", "reviews", "requests", ctes=_MODES),
    "not_comparable_fallback": oracle(
        "SELECT repo_id, CASE WHEN gone THEN 'full' ELSE mode END AS mode, "
        "CASE WHEN NOT gone THEN base_sha END AS base_sha, gone AS fell_back, "
        "CASE WHEN mode = 'incremental' AND compare_status = 500 THEN 'COMPARE_FAILED' END AS mode_error "
        "FROM (SELECT *, mode = 'incremental' AND compare_status = 404 AS gone FROM m) t",
        "reviews", "requests", ctes=_MODES),
    "target_branch": oracle(
        "SELECT r.repo_id, coalesce(nullif(trim(r.branch), ''), p.branch, 'trunk') AS target_branch, "
        "substr(p.head_sha, 1, 7) AS short_sha FROM fx_requests r LEFT JOIN p ON p.repo_id = r.repo_id",
        "reviews", "requests", ctes=_POINTER),
    "unchanged_report": oracle(
        "SELECT m.repo_id, -m.repo_id AS review_id, 'incremental' AS mode, base_sha, head_sha, "
        "'No changes since the last review.' AS summary, CAST(NULL AS INT) AS score, "
        "n AS issue_count, n AS lint_issues_found, false AS pr_opened FROM (SELECT m.*, "
        "(SELECT count(*) FROM fx_findings f JOIN p ON p.review_id = f.review_id "
        "WHERE p.repo_id = m.repo_id) AS n FROM m WHERE mode = 'unchanged') m",
        "reviews", "findings", "requests", ctes=_MODES),
    "owned_requests": (
        "SELECT a.c_custkey + 3 AS repo_id, CAST(a.c_custkey % 25 AS INT) AS user_id, "
        "CASE WHEN b.c_custkey IS NULL THEN 'REPOSITORY_NOT_FOUND' END AS error FROM customer a "
        "LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 3 AND b.c_nationkey = a.c_custkey % 25"
    ),
    "owned_repos": (
        "SELECT c_custkey AS repo_id, c_name AS full_name, c_nationkey AS user_id FROM customer "
        "WHERE c_nationkey = 7"
    ),
    "repositories_with_owner": (
        "SELECT c_custkey AS repo_id, lower(n_name) AS owner_email, n_name AS owner_name "
        "FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"
    ),
    "reviews_with_repository": (
        "SELECT o_orderkey AS review_id, o_custkey AS repo_id, c_name AS full_name, "
        "c_nationkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey"
    ),
    "register_repos": (
        "WITH c AS (SELECT concat('repo-', CAST(o_custkey % 500 AS STRING), '-', o_orderpriority) "
        "AS github_id, o_orderkey AS repo_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN true END, false) "
        "AS private, row_number() OVER (PARTITION BY o_custkey % 500, o_orderpriority "
        "ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) SELECT github_id, repo_id, private FROM c "
        "WHERE rn = 1 AND github_id NOT IN (SELECT concat('repo-', CAST(c_custkey * 4 AS STRING), '-5-LOW') "
        "FROM customer)"
    ),
    "unique_audit": (
        "SELECT concat(c_mktsegment, '-', CAST(c_nationkey AS STRING)) AS email, count(*) AS n "
        "FROM customer GROUP BY 1 HAVING count(*) > 1"
    ),
    "fk_audit": (
        "SELECT o_custkey AS repo_id, o_orderkey AS review_id FROM orders WHERE NOT EXISTS (SELECT 1 "
        "FROM customer WHERE c_custkey = o_custkey AND c_custkey % 9 <> 0)"
    ),
}
