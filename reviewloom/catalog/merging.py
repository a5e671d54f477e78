"""Incremental-merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.views import ISSUE_KEY, WEIGHT, oracle
from reviewloom.operators import compare, history, merge
from reviewloom.sources.samples import Samples


def changed_files(spark, sf_dir):
    return compare.changed_files(Samples(spark, sf_dir).view("compares"))


def compare_summary(spark, sf_dir):
    return compare.compare_summary(Samples(spark, sf_dir).view("compares"))


def change_totals(spark, sf_dir):
    return compare.change_totals(Samples(spark, sf_dir).changes())


def incremental_lint_scope(spark, sf_dir):
    s = Samples(spark, sf_dir)
    kept = merge.in_changed_files(s.lint_findings(), s.changes(), ["review_id"])
    return kept.select("review_id", "seq", "file")


def dropped_paths(spark, sf_dir):
    return merge.dropped_paths(Samples(spark, sf_dir).changes(), "review_id").distinct()


def _last_two_rounds(s: Samples):
    """Per repository: issues of the round before the latest, and issues and changes of the latest."""
    recent = history.recent_reviews(s.reviews().select("review_id", "repo_id", "created_at"), 2)
    latest = recent.where(F.col("age") == 1).select("review_id", "repo_id")
    before = recent.where(F.col("age") == 2).select("review_id", "repo_id")
    issues = s.issues()
    return (
        issues.join(before, "review_id"),
        issues.join(latest, "review_id"),
        s.changes().join(latest, "review_id"),
    )


def merge_one_round(spark, sf_dir):
    merged = merge.merge_round(*_last_two_rounds(Samples(spark, sf_dir)))
    return merged.select("repo_id", "origin", "review_id", "seq", "file", "message")


def merge_with_renames(spark, sf_dir):
    merged = merge.merge_round(*_last_two_rounds(Samples(spark, sf_dir)), carry_renames=True)
    return merged.select("repo_id", "origin", "review_id", "seq", "file", "message")


def _open(spark, sf_dir):
    s = Samples(spark, sf_dir)
    rounds = s.reviews().select("review_id", "repo_id", "created_at", "mode")
    return merge.open_issues(rounds, s.issues(), s.changes())


def open_issues(spark, sf_dir):
    return merge.open_issue_totals(_open(spark, sf_dir))


def open_issue_list(spark, sf_dir):
    return _open(spark, sf_dir).select("repo_id", "review_id", "seq", "file", "severity", "message")


def open_issues_past(spark, sf_dir):
    s = Samples(spark, sf_dir)
    rounds = s.reviews().select("review_id", "repo_id", "created_at", "mode")
    opened = merge.open_issues_as_of(rounds, s.issues(), s.changes(), "1998-01-01")
    return merge.open_issue_totals(opened)


_ROUNDS = (
    "a AS (SELECT review_id, repo_id FROM fx_reviews WHERE age = 1), "
    "b AS (SELECT review_id, repo_id FROM fx_reviews WHERE age = 2), "
    "c AS (SELECT c.*, a.repo_id FROM fx_changes c JOIN a ON a.review_id = c.review_id), "
    "d AS (SELECT repo_id, coalesce(previous_filename, filename) AS file FROM c WHERE status <> 'added' "
    "UNION SELECT repo_id, filename FROM c WHERE status = 'removed'), "
)
_MERGED = (
    "x AS (SELECT p.*, 0 AS origin FROM p UNION ALL SELECT f.review_id, f.seq, f.file, f.line, "
    "f.category, f.message, a.repo_id, 1 AS origin FROM fx_findings f JOIN a ON a.review_id = f.review_id), "
    f"y AS (SELECT *, row_number() OVER (PARTITION BY repo_id, {ISSUE_KEY} ORDER BY origin, seq) AS rn "
    "FROM x)"
)
_PREVIOUS = (
    "p AS (SELECT f.review_id, f.seq, f.file, f.line, f.category, f.message, b.repo_id "
    "FROM fx_findings f JOIN b ON b.review_id = f.review_id "
    "LEFT JOIN d ON d.repo_id = b.repo_id AND d.file = f.file WHERE d.file IS NULL), "
)
_MOVED = (
    "m AS (SELECT repo_id, previous_filename AS file, max(filename) AS moved FROM c "
    "WHERE status = 'renamed' AND previous_filename IS NOT NULL GROUP BY ALL), "
    "p AS (SELECT f.review_id, f.seq, coalesce(m.moved, f.file) AS file, f.line, f.category, f.message, "
    "b.repo_id FROM fx_findings f JOIN b ON b.review_id = f.review_id "
    "LEFT JOIN m ON m.repo_id = b.repo_id AND m.file = f.file "
    "LEFT JOIN d ON d.repo_id = b.repo_id AND d.file = f.file "
    "WHERE d.file IS NULL OR m.file IS NOT NULL), "
)
_OPEN = (
    "inc AS (SELECT DISTINCT review_id FROM fx_changes), "
    "r AS (SELECT v.*, max(CASE WHEN mode = 'full' THEN round_no END) OVER (PARTITION BY repo_id) "
    "AS last_full, max(CASE WHEN mode = 'incremental' AND inc.review_id IS NOT NULL THEN round_no END) "
    "OVER (PARTITION BY repo_id) AS last_changed FROM {rounds} v "
    "LEFT JOIN inc ON inc.review_id = v.review_id), "
    "t0 AS (SELECT r.repo_id, r.round_no, c.filename, c.previous_filename, c.status FROM fx_changes c "
    "JOIN r ON r.review_id = c.review_id WHERE r.mode = 'incremental'), "
    "touch AS (SELECT repo_id, file, max(round_no) AS last_touch FROM (SELECT repo_id, "
    "coalesce(previous_filename, filename) AS file, round_no FROM t0 WHERE status <> 'added' "
    "UNION ALL SELECT repo_id, filename, round_no FROM t0 WHERE status = 'removed') u "
    "GROUP BY repo_id, file), "
    "alive AS (SELECT r.repo_id, r.round_no, f.*, coalesce(r.last_changed > r.last_full, false) AS dd "
    "FROM fx_findings f JOIN r ON r.review_id = f.review_id "
    "LEFT JOIN inc ON inc.review_id = f.review_id "
    "LEFT JOIN touch t ON t.repo_id = r.repo_id AND t.file = f.file "
    "WHERE r.round_no >= r.last_full AND (r.mode = 'full' OR inc.review_id IS NOT NULL) "
    "AND (t.last_touch IS NULL OR t.last_touch <= r.round_no)), "
    f"z AS (SELECT *, row_number() OVER (PARTITION BY repo_id, {ISSUE_KEY} ORDER BY round_no, seq) AS rn "
    "FROM alive)"
)
_MERGE_SELECT = "SELECT repo_id, origin, review_id, seq, file, message FROM y WHERE rn = 1"
_TOTALS = (
    f"SELECT repo_id, count(*) AS open_issues, CAST(sum({WEIGHT}) AS BIGINT) AS weighted FROM z "
    "WHERE rn = 1 OR NOT dd GROUP BY repo_id"
)

QUERIES = {
    "changed_files": changed_files,
    "compare_summary": compare_summary,
    "change_totals": change_totals,
    "incremental_lint_scope": incremental_lint_scope,
    "dropped_paths": dropped_paths,
    "merge_one_round": merge_one_round,
    "merge_with_renames": merge_with_renames,
    "open_issues": open_issues,
    "open_issue_list": open_issue_list,
    "open_issues_past": open_issues_past,
}

ORACLES = {
    "changed_files": oracle(
        "SELECT repo_id, review_id, CAST(i - 1 AS INT) AS file_no, f->>'filename' AS filename, "
        "f->>'previous_filename' AS previous_filename, f->>'status' AS status, f->>'patch' AS patch, "
        "CAST(f->>'additions' AS INT) AS additions, CAST(f->>'deletions' AS INT) AS deletions FROM ("
        "SELECT repo_id, review_id, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM ("
        "SELECT repo_id, review_id, from_json(payload->'files', '[\"JSON\"]') AS fs FROM fx_compares "
        "WHERE base_sha <> head_sha AND payload->>'status' <> 'identical') a) b", "compares"),
    "compare_summary": oracle(
        "SELECT review_id, CASE WHEN same THEN 0 ELSE CAST(payload->>'total_commits' AS INT) END "
        "AS total_commits, 0 AS ahead_by, CAST(payload->>'behind_by' AS INT) AS behind_by FROM ("
        "SELECT *, base_sha = head_sha OR payload->>'status' = 'identical' AS same FROM fx_compares) t",
        "compares"),
    "change_totals": oracle(
        "SELECT review_id, status, count(*) AS files, CAST(sum(additions) AS BIGINT) AS additions, "
        "CAST(sum(deletions) AS BIGINT) AS deletions FROM fx_changes GROUP BY review_id, status",
        "changes"),
    "incremental_lint_scope": oracle(
        "SELECT review_id, seq, file FROM fx_findings f WHERE EXISTS (SELECT 1 FROM fx_changes c "
        "WHERE c.review_id = f.review_id AND c.filename = f.file)", "findings", "changes"),
    "dropped_paths": oracle(
        "SELECT review_id, coalesce(previous_filename, filename) AS file FROM fx_changes "
        "WHERE status <> 'added' UNION SELECT review_id, filename FROM fx_changes "
        "WHERE status = 'removed'", "changes"),
    "merge_one_round": oracle(
        _MERGE_SELECT, "reviews", "findings", "changes", ctes=_ROUNDS + _PREVIOUS + _MERGED),
    "merge_with_renames": oracle(
        _MERGE_SELECT, "reviews", "findings", "changes", ctes=_ROUNDS + _MOVED + _MERGED),
    "open_issues": oracle(_TOTALS, "reviews", "findings", "changes", ctes=_OPEN.replace("{rounds}", "fx_reviews")),
    "open_issues_past": oracle(
        _TOTALS, "reviews", "findings", "changes", ctes=_OPEN.replace(
            "{rounds}", "(SELECT * FROM fx_reviews WHERE created_at <= TIMESTAMP '1998-01-01')")),
    "open_issue_list": oracle(
        "SELECT repo_id, review_id, seq, file, severity, message FROM z WHERE rn = 1 OR NOT dd",
        "reviews", "findings", "changes", ctes=_OPEN.replace("{rounds}", "fx_reviews")),
}
