"""Repository-URL, eligibility and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.views import oracle
from reviewloom.functions import urls as U
from reviewloom.operators import eligibility
from reviewloom.plans import review
from reviewloom.sources.samples import Samples


def repo_url_parse(spark, sf_dir):
    url = F.col("raw_url")
    return Samples(spark, sf_dir).view("repo_urls").select(
        "page_id", U.url_error(url).alias("url_error"), U.strict_owner(url).alias("owner"),
        U.strict_repo(url).alias("repo"), U.is_gist_url(url).alias("is_gist"),
    )


def repo_url_preflight(spark, sf_dir):
    return Samples(spark, sf_dir).view("repo_urls").select(
        "page_id", U.preflight_error(F.col("raw_url")).alias("error")
    )


def tracked_url_parse(spark, sf_dir):
    rows = Samples(spark, sf_dir).view("repo_urls").withColumn(
        "t", U.tracked_repository(F.col("raw_url"))
    )
    return rows.select("page_id", "t.owner", "t.name", "t.full_name", "t.url")


def repo_eligibility(spark, sf_dir):
    rows = eligibility.check_eligibility(Samples(spark, sf_dir).view("metadata"), 20)
    return rows.select("repo_id", "eligibility_code", "eligibility_message", "visibility")


def metadata_warnings(spark, sf_dir):
    rows = Samples(spark, sf_dir).view("metadata").select(
        "repo_id", F.posexplode(eligibility.metadata_warnings()).alias("pos", "w")
    )
    return rows.select("repo_id", "pos", "w.code", "w.message")


def size_gate(spark, sf_dir):
    requests = Samples(spark, sf_dir).view("metadata").select(
        "repo_id", "size_kb", F.lit("o").alias("owner"), F.lit("r").alias("repo"),
        F.col("default_branch").alias("branch"),
    )
    return eligibility.size_gate(requests).select("repo_id", "gate_code", "gate_message")


def api_status(spark, sf_dir):
    return eligibility.classify_api_calls(Samples(spark, sf_dir).view("api_calls"))


def admitted_requests(spark, sf_dir):
    """Admission of one request per customer, some with a broken URL or a blocked repository."""
    s = Samples(spark, sf_dir)
    requests = s.table("customer").selectExpr(
        "c_custkey AS repo_id", "c_custkey * 2 AS review_id",
        "CASE c_custkey % 37 WHEN 0 THEN 'https://github.com/orgs/x' WHEN 1 THEN '' "
        "ELSE concat('https://github.com/o/r', CAST(c_custkey AS STRING)) END AS repo_url",
    )
    gate = s.table("customer").where("c_custkey % 41 = 0").selectExpr(
        "c_custkey AS repo_id", "'SECRETS_FOUND' AS code"
    )
    rows = review.admit(requests, s.view("metadata"), gate)
    return rows.select("repo_id", "review_id", "error_code", "default_branch")


_TAIL = "([/?#].*)?$"
_HOST = "^(?i)(https?://)?(www\\.)?github\\.com/"
_GIST = "regexp_matches(raw_url, '^(?i)(https?://)?(www\\.)?(gist\\.github\\.com|github\\.com/gist)')"
_RESERVED = (
    "lower(regexp_extract(raw_url, '" + _HOST + "([^/?#\\s]+)/', 3)) IN "
    "('orgs', 'settings', 'marketplace', 'features', 'pricing', 'login', 'signup', 'gist', 'gists')"
)
_FULL = "'" + _HOST + "([^/?#\\s]+)/([^/?#\\s]+?)(\\.git)?" + _TAIL + "'"
_PARSED = (
    f"u AS (SELECT page_id, raw_url, {_GIST} AS is_gist, CASE WHEN {_GIST} THEN 'GIST_NOT_SUPPORTED' "
    f"WHEN NOT regexp_matches(raw_url, {_FULL}) OR {_RESERVED} THEN 'INVALID_URL' END AS url_error "
    "FROM fx_repo_urls)"
)
_TRACKED = "'^(https?://)?(www\\.)?github\\.com/([^/]+)/([^/]+?)(\\.git)?/?$'"
_STATUS = (
    "CASE WHEN endpoint = 'commits' AND http_status = 409 THEN 'REPO_EMPTY' "
    "WHEN endpoint IN ('metadata', 'zipball') AND http_status = 404 THEN 'REPO_NOT_FOUND' "
    "WHEN endpoint = 'metadata' AND http_status = 401 THEN 'TOKEN_INVALID' "
    "WHEN endpoint = 'metadata' AND http_status = 403 THEN 'TOKEN_FORBIDDEN' "
    "WHEN endpoint = 'zipball' AND http_status = 403 THEN 'DOWNLOAD_FORBIDDEN' "
    "WHEN endpoint = 'head' AND http_status = 404 THEN 'BRANCH_NOT_FOUND' "
    "WHEN endpoint = 'compare' AND http_status = 404 THEN 'BASE_NOT_COMPARABLE' "
    "WHEN http_status < 400 THEN NULL "
    "ELSE CASE endpoint WHEN 'rate_limit' THEN 'RATE_LIMIT_CHECK_FAILED' WHEN 'metadata' THEN "
    "'GITHUB_API_ERROR' WHEN 'commits' THEN 'COMMIT_CHECK_FAILED' WHEN 'head' THEN 'HEAD_LOOKUP_FAILED' "
    "WHEN 'compare' THEN 'COMPARE_FAILED' ELSE 'DOWNLOAD_FAILED' END END"
)
_CODES = (
    "c AS (SELECT *, CASE WHEN rate_remaining < 10 THEN 'RATE_LIMIT_LOW' "
    "WHEN http_status = 404 THEN 'REPO_NOT_FOUND' WHEN http_status = 401 THEN 'TOKEN_INVALID' "
    "WHEN http_status = 403 THEN 'TOKEN_FORBIDDEN' WHEN http_status >= 400 THEN 'GITHUB_API_ERROR' "
    "WHEN size_kb = 0 OR NOT has_commits THEN 'REPO_EMPTY' "
    "WHEN default_branch IS NULL THEN 'DEFAULT_BRANCH_MISSING' "
    "WHEN rate_remaining < {minimum} THEN 'RATE_LIMIT_LOW' END AS code FROM fx_metadata)"
)
_MB1 = "CAST(CAST(floor(size_kb * 10 / 1024.0 + 0.5) AS BIGINT) // 10 AS STRING)"
_MB1D = "CAST(CAST(floor(size_kb * 10 / 1024.0 + 0.5) AS BIGINT) % 10 AS STRING)"

QUERIES = {
    "repo_url_parse": repo_url_parse,
    "repo_url_preflight": repo_url_preflight,
    "tracked_url_parse": tracked_url_parse,
    "repo_eligibility": repo_eligibility,
    "metadata_warnings": metadata_warnings,
    "size_gate": size_gate,
    "api_status": api_status,
    "admitted_requests": admitted_requests,
}

ORACLES = {
    "repo_url_parse": oracle(
        f"SELECT page_id, url_error, CASE WHEN url_error IS NULL THEN regexp_extract(raw_url, {_FULL}, 3) "
        f"END AS owner, CASE WHEN url_error IS NULL THEN regexp_extract(raw_url, {_FULL}, 4) END AS repo, "
        "is_gist FROM u", "repo_urls", ctes=_PARSED),
    "repo_url_preflight": oracle(
        "SELECT page_id, CASE WHEN NOT regexp_matches(raw_url, "
        "'^https?://(www\\.)?github\\.com/[^/]+/[^/]+') THEN 'INVALID_REPO_URL' END AS error "
        "FROM fx_repo_urls", "repo_urls"),
    "tracked_url_parse": oracle(
        "SELECT page_id, o AS owner, n AS name, o || '/' || n AS full_name, "
        "'https://github.com/' || o || '/' || n AS url FROM (SELECT page_id, "
        f"CASE WHEN regexp_matches(raw_url, {_TRACKED}) THEN regexp_extract(raw_url, {_TRACKED}, 3) END AS o, "
        f"CASE WHEN regexp_matches(raw_url, {_TRACKED}) THEN regexp_extract(raw_url, {_TRACKED}, 4) END AS n "
        "FROM fx_repo_urls) t", "repo_urls"),
    "repo_eligibility": oracle(
        "SELECT repo_id, code AS eligibility_code, CASE code WHEN 'RATE_LIMIT_LOW' THEN concat('GitHub API "
        "rate limit is too low (', CAST(rate_remaining AS STRING), ' requests remaining). Try again "
        "later.') WHEN 'REPO_NOT_FOUND' THEN CASE WHEN has_token THEN 'Repository not found or your token "
        "does not have access to it.' ELSE 'Repository not found. Private repositories require a GitHub "
        "token.' END WHEN 'TOKEN_INVALID' THEN 'GitHub token is invalid or expired.' "
        "WHEN 'TOKEN_FORBIDDEN' THEN coalesce(response_message, 'GitHub token lacks permission to access "
        "this repository.') WHEN 'GITHUB_API_ERROR' THEN 'Failed to fetch repository metadata from "
        "GitHub.' WHEN 'REPO_EMPTY' THEN CASE WHEN size_kb = 0 THEN 'Repository appears to be empty (size "
        "is 0 KB).' ELSE 'Repository has no commits.' END WHEN 'DEFAULT_BRANCH_MISSING' THEN 'Repository "
        "metadata is missing default_branch.' END AS eligibility_message, "
        "CASE WHEN private THEN 'private' ELSE 'public' END AS visibility FROM c",
        "metadata", ctes=_CODES.replace("{minimum}", "20")),
    "metadata_warnings": oracle(
        "SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY o) - 1 AS INT) AS pos, code, "
        "message FROM (SELECT repo_id, 0 AS o, 'REPO_ARCHIVED' AS code, 'Repository is archived. Review "
        "results may be outdated.' AS message FROM fx_metadata WHERE archived UNION ALL "
        "SELECT repo_id, 1, 'REPO_LARGE', concat('Repository size is approximately ', "
        f"{_MB1}, '.', {_MB1D}, ' MB (GitHub metadata). Large repos may be slow to process.') "
        "FROM fx_metadata WHERE size_kb > 512000 UNION ALL "
        "SELECT repo_id, 2, 'REPO_DISABLED', 'Repository is disabled on GitHub.' FROM fx_metadata "
        "WHERE disabled UNION ALL SELECT repo_id, 3, 'REPO_FORK', 'Repository is a fork. Consider "
        "reviewing the upstream source of truth.' FROM fx_metadata WHERE fork) w", "metadata"),
    "size_gate": oracle(
        "SELECT repo_id, CASE WHEN default_branch IS NULL THEN 'INVALID_INPUT' WHEN size_kb > 204800 "
        "THEN 'REPO_TOO_LARGE' END AS gate_code, CASE WHEN default_branch IS NULL THEN 'owner, repo, and "
        "branch are required.' WHEN size_kb > 204800 THEN concat('Repository is too large to download (≈', "
        "CAST(CAST(floor(size_kb / 1024.0 + 0.5) AS BIGINT) AS STRING), ' MB). Maximum allowed size is 200 "
        "MB.') END AS gate_message FROM fx_metadata", "metadata"),
    "api_status": oracle(
        f"SELECT *, CASE WHEN error_code = 'REPO_EMPTY' THEN 422 WHEN error_code IS NOT NULL THEN "
        f"http_status END AS error_status FROM (SELECT *, {_STATUS} AS error_code FROM fx_api_calls) t",
        "api_calls"),
    "admitted_requests": oracle(
        "SELECT repo_id, repo_id * 2 AS review_id, default_branch, CASE repo_id % 37 WHEN 0 THEN "
        "'INVALID_URL' WHEN 1 THEN 'MISSING_REPO_URL' ELSE coalesce(code, CASE WHEN size_kb > 204800 THEN "
        "'REPO_TOO_LARGE' WHEN repo_id % 41 = 0 THEN 'SECRETS_FOUND' END) END AS error_code FROM c",
        "metadata", ctes=_CODES.replace("{minimum}", "10")),
}
