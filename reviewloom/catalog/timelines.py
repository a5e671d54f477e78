"""Queries over whole histories: renamed files, and what was open after each round."""

from __future__ import annotations

from reviewloom.catalog.views import ISSUE_KEY, oracle
from reviewloom.operators import timeline
from reviewloom.sources.samples import Samples


def open_issues_renamed(spark, sf_dir):
    """Open issues under the present names of their files."""
    s = Samples(spark, sf_dir)
    opened = timeline.open_issues_with_renames(s.long_rounds(), s.view("long_findings"), s.long_changes())
    return opened.select("repo_id", "review_id", "seq", "file", "line", "message")


def _intervals(s: Samples):
    return timeline.issue_intervals(s.long_rounds(), s.view("long_findings"), s.long_changes())


def issue_intervals(spark, sf_dir):
    """Opening and closing round of every issue."""
    return _intervals(Samples(spark, sf_dir))


def open_after_rounds(spark, sf_dir):
    """Number of open issues after every round."""
    s = Samples(spark, sf_dir)
    return timeline.open_after_rounds(s.long_rounds(), s.long_changes(), _intervals(s))


_BASE = (
    "inc AS (SELECT DISTINCT review_id FROM fx_long_changes), "
    "r AS (SELECT v.*, v.mode = 'full' OR inc.review_id IS NOT NULL AS counts, "
    "row_number() OVER (PARTITION BY repo_id ORDER BY created_at, v.review_id) AS round_no "
    "FROM fx_long v LEFT JOIN inc ON inc.review_id = v.review_id), "
    "c AS (SELECT r.repo_id, r.round_no, c.* FROM fx_long_changes c JOIN r ON r.review_id = c.review_id "
    "WHERE r.mode = 'incremental'), "
    "ev AS (SELECT repo_id, round_no, file, max(moved_to) AS moved_to FROM ("
    "SELECT repo_id, round_no, filename AS file, NULL AS moved_to FROM c WHERE status = 'removed' UNION ALL "
    "SELECT repo_id, round_no, coalesce(previous_filename, filename), CASE WHEN status = 'renamed' AND "
    "previous_filename IS NOT NULL THEN filename END FROM c WHERE status <> 'added') u GROUP BY ALL), "
    "n AS (SELECT r.repo_id, r.round_no, r.mode, f.* FROM fx_long_findings f JOIN r ON r.review_id = f.review_id "
    "WHERE r.counts)"
)
# Round by round: drop or rename what was open, take up the new issues, keep the first of equal ones.
_FOLD = (
    _BASE + ", fold AS (SELECT DISTINCT repo_id, CAST(0 AS BIGINT) AS upto, CAST(NULL AS BIGINT) AS born, "
    "CAST(NULL AS BIGINT) AS review_id, CAST(NULL AS BIGINT) AS seq, '' AS file, CAST(NULL AS BIGINT) AS line, "
    "'' AS category, '' AS message FROM r "
    "UNION ALL SELECT repo_id, upto, born, review_id, seq, file, line, category, message FROM ("
    "SELECT t.*, row_number() OVER (PARTITION BY repo_id, born IS NULL, "
    f"{ISSUE_KEY} ORDER BY born, seq) AS place FROM ("
    "SELECT f.repo_id, r.round_no AS upto, f.born, f.review_id, f.seq, coalesce(ev.moved_to, f.file) AS file, f.line, "
    "f.category, f.message, r.mode, r.counts FROM fold f JOIN r ON r.repo_id = f.repo_id AND r.round_no = f.upto + 1 "
    "LEFT JOIN ev ON ev.repo_id = f.repo_id AND ev.round_no = f.upto + 1 AND ev.file = f.file "
    "WHERE f.born IS NULL OR (r.mode <> 'full' AND (ev.file IS NULL OR ev.moved_to IS NOT NULL)) "
    "UNION ALL SELECT n.repo_id, n.round_no, n.round_no, n.review_id, n.seq, n.file, n.line, n.category, n.message, "
    "n.mode, true FROM fold f JOIN n ON n.repo_id = f.repo_id AND n.round_no = f.upto + 1 WHERE f.born IS NULL"
    ") t) u WHERE place = 1 OR mode = 'full' OR NOT counts)"
)
_INTERVALS = (
    _BASE + ", a AS (SELECT n.repo_id, n.review_id, n.seq, n.file, n.severity, n.mode, n.round_no AS opened, "
    f"{ISSUE_KEY} AS key, least("
    "(SELECT min(round_no) FROM ev WHERE ev.repo_id = n.repo_id AND ev.file = n.file AND ev.round_no > n.round_no), "
    "(SELECT min(round_no) FROM r WHERE r.repo_id = n.repo_id AND r.mode = 'full' AND r.round_no > n.round_no)) AS closed, "
    "(SELECT min(round_no) FROM r WHERE r.repo_id = n.repo_id AND r.mode <> 'full' AND r.counts AND "
    "r.round_no > n.round_no) AS merged FROM n), "
    "b AS (SELECT *, rank() OVER (PARTITION BY repo_id, key, closed ORDER BY opened, seq) AS place FROM a), "
    "i AS (SELECT repo_id, review_id, seq, file, severity, opened, CASE WHEN place = 1 THEN closed "
    "ELSE least(closed, merged) END AS closed FROM b WHERE place = 1 OR mode = 'full')"
)

QUERIES = {
    "open_issues_renamed": open_issues_renamed,
    "issue_intervals": issue_intervals,
    "open_after_rounds": open_after_rounds,
}

ORACLES = {
    "open_issues_renamed": oracle(
        "SELECT f.repo_id, review_id, seq, file, line, message FROM fold f JOIN (SELECT repo_id, max(round_no) AS upto "
        "FROM r GROUP BY repo_id) e ON e.repo_id = f.repo_id AND e.upto = f.upto WHERE born IS NOT NULL",
        "long", "long_changes", ctes=_FOLD).replace("WITH ", "WITH RECURSIVE ", 1),
    "issue_intervals": oracle(
        "SELECT * FROM i", "long", "long_changes", ctes=_INTERVALS),
    "open_after_rounds": oracle(
        "SELECT r.repo_id, r.review_id, r.round_no, count(i.seq) AS open_issues FROM r LEFT JOIN i ON "
        "i.repo_id = r.repo_id AND i.opened <= r.round_no AND (i.closed IS NULL OR i.closed > r.round_no) "
        "GROUP BY ALL", "long", "long_changes", ctes=_INTERVALS),
}
