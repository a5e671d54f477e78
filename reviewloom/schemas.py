"""Canonical table schemas (DDL strings, usable with ``spark.read.schema``)."""

ISSUE = (
    "repo_id string, review_id string, seq bigint, file string, line int, severity string, "
    "category string, message string, suggestion string"
)
LINT_FINDING = (
    "repo_id string, linter string, file string, seq bigint, line int, `column` int, "
    "severity string, message string, rule_id string, source string"
)
LINTER_RUN = "repo_id string, linter string, status string, error string, reason string"
FILE = "repo_id string, path string, content string"
CHANGED_FILE = (
    "repo_id string, review_id string, file_no int, filename string, previous_filename string, "
    "status string, patch string, additions int, deletions int"
)
SECRET_FINDING = (
    "repo_id string, path string, line int, pattern_id string, label string, match_preview string"
)
LINT_REPORT = "repo_id string, linter string, root string, payload string"
MODEL_RESPONSE = (
    "review_id string, provider string, attempt_pos int, text string, error string, status int"
)
REPOSITORY = (
    "repo_id string, github_id string, name string, full_name string, owner string, url string, "
    "private boolean, user_id string, created_at timestamp"
)
REVIEW = (
    "review_id string, repo_id string, mode string, base_sha string, head_sha string, "
    "branch string, score int, summary string, pr_created boolean, pr_url string, "
    "pr_number int, created_at timestamp"
)
COMPARE_PAYLOAD = (
    "status string, total_commits int, ahead_by int, behind_by int, "
    "files array<struct<filename:string, previous_filename:string, status:string, "
    "patch:string, additions:int, deletions:int>>"
)
